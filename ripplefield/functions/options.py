"""The textual option language: names and aliases, in any case, parsed on the driver."""

from __future__ import annotations

# Accepted spellings of each option.
OPTIONS = {
    "pad_side": {"left": ("left", "start", "l"), "right": ("right", "end", "r")},
    "normalization": {"minmax": ("minmax", "min_max", "min-max"), "peak": ("peak",), "mean": ("mean",), "median": ("median",), "zscore": ("zscore", "z_score", "z-score")},
    "fade_curve": {"linear": ("linear",), "exponential": ("exponential", "exp"), "logarithmic": ("logarithmic", "log"), "smoothstep": ("smoothstep", "smooth_step", "smooth")},
    "vad_method": {"energy": ("energy", "rms"), "zero_crossing": ("zero_crossing", "zerocrossing", "zcr"), "combined": ("combined", "both")},
    "resampling_quality": {"fast": ("fast", "low"), "medium": ("medium", "balanced"), "high": ("high", "best")},
    "spectrogram_scale": {"linear": ("linear", "lin"), "log": ("log", "logarithmic"), "mel": ("mel",)},
    "pitch_method": {"yin": ("yin",), "autocorrelation": ("autocorrelation", "autocorr", "acf")},
    "iir_family": {"butterworth": ("butterworth", "butter"), "chebyshev1": ("chebyshev1", "chebyshevi", "cheby1"), "chebyshev2": ("chebyshev2", "chebyshevii", "cheby2"), "bessel": ("bessel",), "elliptic": ("elliptic", "ellip", "cauer")},
    "filter_response": {"lowpass": ("lowpass", "low_pass", "lp"), "highpass": ("highpass", "high_pass", "hp"), "bandpass": ("bandpass", "band_pass", "bp"), "bandstop": ("bandstop", "band_stop", "bs", "notch")},
    "eq_band": {"peak": ("peak", "bell"), "low_shelf": ("low_shelf", "lowshelf"), "high_shelf": ("high_shelf", "highshelf"), "low_pass": ("low_pass", "lowpass"), "high_pass": ("high_pass", "highpass"), "band_pass": ("band_pass", "bandpass"), "band_stop": ("band_stop", "bandstop", "notch")},
    "knee": {"hard": ("hard",), "soft": ("soft",)},
    "detection": {"peak": ("peak",), "rms": ("rms",), "hybrid": ("hybrid",)},
    "threshold": {"delta": ("delta",), "percentile": ("percentile",), "combined": ("combined",)},
    "noise_color": {"white": ("white",), "pink": ("pink",), "brown": ("brown", "red", "brownian")},
    "flux": {"energy": ("energy",), "magnitude": ("magnitude", "mag"), "complex": ("complex",), "rectified": ("rectified", "rectified_complex", "rectifiedcomplex")},
    "sample_format": {"u8": ("u8", "uint8"), "i16": ("i16", "int16"), "i24": ("i24", "int24"), "i32": ("i32", "int32"), "f32": ("f32", "float32", "float"), "f64": ("f64", "float64", "double")},
}


def parse(option: str, text: str) -> str:
    """The canonical value of an option's spelling; ``ValueError`` names what is accepted."""
    table = OPTIONS[option]
    wanted = text.strip().lower().replace(" ", "_")
    for value, spellings in table.items():
        if wanted in spellings:
            return value
    raise ValueError(f"{text!r} is no {option}; known: {', '.join(table)}")
