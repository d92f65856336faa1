"""See the package docstring of ``ripplefield`` for how the parts fit together."""
