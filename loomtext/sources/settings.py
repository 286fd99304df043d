"""Settings from flat ``key: value`` lines, read on the driver: fields with types, defaults and ranges."""

from __future__ import annotations

import re

# The names of the settings, their defaults and their ranges (least, most).
TASKS = {
    "structure_only": (1200, 1.15, 1800),
    "quick_cleanup": (1000, 1.05, 3200),
    "cleanup_zh": (1000, 1.05, 3200),
    "translate_only": (900, 1.10, 1500),
    "summarize": (2500, 0.15, 384),
}
WHOLE = {
    "yt_dlp_socket_timeout_sec": (15, 1), "yt_dlp_retries": (1, 0), "yt_dlp_extractor_retries": (1, 0), "llm_timeout_sec": (120, 1), "llm_max_retries": (3, 0),
    "llm_probe_timeout_sec": (20, 1), "llm_probe_max_tokens": (16, 1), "llm_stop_after_consecutive_timeouts": (2, 1), "llm_chunk_recovery_attempts": (1, 0),
    "llm_reasoning_retry_attempts": (2, 0), "llm_reasoning_retry_max_tokens": (4096, 1), "chunk_size_override": (0, 0), "chunk_safety_buffer_tokens": (400, 0),
    "chunk_overlap_sentences": (0, 0), "chunk_context_tail_sentences": (1, 0), "chunk_context_summary_tokens": (60, 0), "autotune_success_window": (20, 1),
    "autotune_p95_latency_threshold_ms": (45_000, 1), "autotune_canary_chunks": (3, 1),
}
REAL = {
    "llm_backoff_sec": (1.5, 0.1, None), "llm_chunk_recovery_backoff_sec": (1.0, 0.0, None), "llm_reasoning_retry_multiplier": (2.0, 1.01, 4.0),
    "chunk_hard_cap_multiplier": (1.33, 1.0, 2.0), "autotune_reduce_percent": (0.25, 0.01, 0.90), "autotune_increase_percent": (0.10, 0.01, 0.50),
}
SWITCH = {"deepgram_enable_utterances": True, "deepgram_prefer_structured_output": True, "llm_reasoning_probe_enabled": True, "enable_token_count_probe": True, "enable_chunk_autotune": False}
# Services, models and formats have no defaults here.
PLAIN = {"output_dir": "", "deepgram_api_key": "", "deepgram_model": "", "llm_api_key": "", "llm_base_url": "", "llm_model": "", "llm_api_format": "", "yt_dlp_cookies_from_browser": "", "yt_dlp_cookies_file": ""}
YES, NO = ("1", "true", "yes", "on", "y"), ("0", "false", "no", "off", "n")


def pairs(text: str) -> dict[str, str]:
    """The ``key: value`` lines of a text, the last of a key counts: no comment lines, no comments behind values, no quotes around them."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, colon, value = line.partition(":")
        if line.startswith("#") or not colon or not key.strip():
            continue
        quoted = re.match(r"""\s*("[^"]*"|'[^']*')\s*(?:#.*)?\Z""", value)
        out[key.strip()] = quoted[1][1:-1] if quoted else value.split("#")[0].strip()
    return out


def load(text: str) -> tuple[dict, list[str]]:
    """(settings, warnings): a number that is none, or outside its range, warns and stays at its default.

    What isn't set for cleanup_zh is taken from structure_only, else from quick_cleanup, where these are set.
    """
    given, warnings, out = pairs(text), [], {}

    def number(key: str, kind: type, default, least=None, most=None):
        raw = given.get(key, "")
        if raw == "":
            return default
        try:
            value = kind(raw)
        except ValueError:
            warnings.append(f"{key}={raw!r} is not a valid {'integer' if kind is int else 'number'}; using default {default}")
            return default
        if (least is not None and value < least) or (most is not None and value > most):
            warnings.append(f"{key}={raw!r} is " + (f"outside [{least}, {most}]" if most is not None else f"below minimum {least}") + f"; using default {default}")
            return default
        return value

    out |= {k: given.get(k, "").strip() or v for k, v in PLAIN.items()}
    out |= {k: number(k, int, *v) for k, v in WHOLE.items()}
    out |= {k: number(k, float, *v) for k, v in REAL.items()}
    for k, v in SWITCH.items():
        said = given.get(k, "").strip().lower()
        out[k] = True if said in YES else False if said in NO else v
    for n, (prefix, kind, least) in enumerate((("chunk_tokens", int, 1), ("output_ratio", float, 0.01), ("max_output_tokens", int, 1))):
        for task, defaults in TASKS.items():
            default = defaults[n]
            if task == "cleanup_zh":
                default = next((out[f"{prefix}_{t}"] for t in ("structure_only", "quick_cleanup") if given.get(f"{prefix}_{t}", "") != ""), default)
            out[f"{prefix}_{task}"] = number(f"{prefix}_{task}", kind, default, least)
    for key, known in (("chunk_mode", ("tokens", "chars")), ("llm_stream", ("auto", "true", "false"))):
        said = given.get(key, "").lower()
        out[key] = said if said in known else known[0]
    return out, warnings
