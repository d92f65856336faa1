"""ripplefield: analytics over sampled signals (and training text) as Spark DataFrames.

Signals live in *long form* ``(clip_id, ch, idx, v)``; every operator is a pure function from
DataFrame to DataFrame.  ``operators`` holds the signal operators, ``functions`` scalar column
expressions and sample-format casts, ``sources`` generators and table adapters, ``streaming`` the
stateful wrappers and ``plans`` the registered queries with their SQL oracles.  The optional
subpackage ``llm`` prepares text corpora; nothing outside it imports it.
"""

__version__ = "0.1.0"
