"""Round trips of the codecs over the clips of a table, against the kernels run clip by clip in numpy."""

import numpy as np
import pytest

from ripplefield.operators import codec
from ripplefield.plans import registry
from ripplefield.sources.tables import event_clips


def snr(x, y):
    return 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum())


@pytest.mark.parametrize("kind", ["perceptual", "frames_auto"])
def test_round_trips_of_all_clips(spark, sf, kind):
    clips = {}
    for r in event_clips(spark, sf, 50.0).orderBy("clip_id", "idx").collect():
        clips.setdefault(r.clip_id, []).append(r.v)
    got = {r.clip_id: r.snr for r in registry.queries()[f"codec_{kind}_clips"](spark, sf).collect()}
    assert set(got) == set(clips)
    for k, x in clips.items():
        x = np.array(x)
        if kind == "perceptual":
            c, y = codec.PerceptualCodec(1000, 8_000, 16, segment=40), []
            for a in range(0, len(x), 40):
                e = c.encode_segment(x[a : a + 40])
                y.append(c.decode_segment(e["length"], e["frames"], np.array(e["steps"]), np.array(e["q"])))
            y = np.concatenate(y)
        else:
            c = codec.FrameCodec(1000, 12_000)
            n, music, history, y = codec.frame_size(1000, 20.0), c._music(), np.zeros(codec.ORDER), []
            for parts in c.encode_channel(x):
                speech, whole = c.decode_frame(parts, n, history, music)
                history = np.r_[history, speech][-codec.ORDER :] if speech is not None else np.zeros(codec.ORDER)
                y.append(whole)
            y = np.concatenate(y)[: len(x)]
        assert got[k] == pytest.approx(snr(x, y), abs=2e-3)
