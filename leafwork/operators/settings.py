"""Settings: layers, presets, masks and what a run may override. All of it is a handful of strings, so it lives on the driver;
``masked_view`` and ``allowed_overrides`` have column forms for tables of jobs."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.text import mask

# Keys a settings file may hold, environment names and the keys they set, presets and per-engine override keys (fixed values).
FILE_KEYS = ("api_key", "base_url", "model", "provider", "tess_lang", "tess_psm", "tess_oem", "tess_config", "tessdata_dir", "tess_cmd", "generic_prompt", "embed_font", "cleanup_max_age_hours", "cleanup_interval_hours", "ocr_cache_enabled", "ocr_cache_max_age_hours", "log_level")
ENVIRONMENT = {"OCR_BASE_URL": "base_url", "OCR_MODEL": "model", "OCR_PROVIDER": "provider", "OCR_TESS_LANG": "tess_lang", "OCR_TESS_PSM": "tess_psm", "OCR_TESS_OEM": "tess_oem", "OCR_TESS_CONFIG": "tess_config", "OCR_TESSDATA_DIR": "tessdata_dir", "OCR_TESS_CMD": "tess_cmd", "OCR_GENERIC_PROMPT": "generic_prompt",
               "OCR_EMBED_FONT": "embed_font", "OCR_CLEANUP_MAX_AGE_HOURS": "cleanup_max_age_hours", "OCR_CLEANUP_INTERVAL_HOURS": "cleanup_interval_hours", "OCR_CACHE_ENABLED": "ocr_cache_enabled", "OCR_CACHE_MAX_AGE_HOURS": "ocr_cache_max_age_hours", "OCR_LOG_LEVEL": "log_level"}
PRESETS = {"openai": {"base_url": "https://api.openai.com/v1", "model": "gpt-4o-mini"}}
OVERRIDES = {"unlimited": ("api_key", "base_url", "model"), "generic_openai": ("api_key", "base_url", "model", "prompt"), "tesseract": ("lang", "psm", "oem", "config", "tessdata_dir", "tess_cmd")}
PROVIDER, MAX_TOKENS = "ustc", 32767


def file_layer(path: str) -> dict[str, str]:
    """The known keys of a TOML file as text (booleans as true and false); nothing from a file that is missing or no TOML."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    except (OSError, ValueError):
        return {}
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k in FILE_KEYS if (v := data.get(k)) is not None}


def environment_layer(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """What the environment sets; empty variables set nothing, and a base address loses its final slashes."""
    env = os.environ if env is None else env
    out = {field: value for name, field in ENVIRONMENT.items() if (value := env.get(name))}
    if key := env.get("OCR_API_KEY") or env.get("USTC_API_KEY"):
        out["api_key"] = key
    if "base_url" in out:
        out["base_url"] = out["base_url"].rstrip("/")
    return out


def resolve(file: Mapping[str, str], saved: Mapping[str, str], env: Mapping[str, str], presets: Mapping[str, Mapping[str, str]] = PRESETS) -> dict[str, str]:
    """The settings in force: environment before saved before file; a provider's preset only fills what none of them says."""
    own = {**file, **saved, **env}
    return {**presets.get(own.get("provider", PROVIDER), {}), **own}


def masked_settings(settings: Mapping[str, str]) -> dict[str, object]:
    """What may be shown: the key masked, and whether there is one."""
    key = settings.get("api_key", "")
    hidden = "*" * len(key) if len(key) <= 8 else key[:4] + "*" * (len(key) - 8) + key[-4:]
    return {"provider": settings.get("provider", PROVIDER), "base_url": settings.get("base_url", ""), "model": settings.get("model", ""), "api_key_masked": hidden, "has_api_key": bool(key)}


def save(path: str, new: Mapping[str, str], saved: Mapping[str, str] = {}) -> dict[str, str]:
    """Write a settings file and return what it holds: other keys stay, and a key that comes back masked keeps the one there was.
    The file is written beside and moved into place."""
    before = file_layer(path)
    key = str(new.get("api_key", "")).strip()
    if "*" in key:
        key = before.get("api_key", saved.get("api_key", ""))
    data = {**before, "api_key": key, "base_url": str(new.get("base_url", "")).strip().rstrip("/"), "model": str(new.get("model", "")).strip(), "provider": str(new.get("provider", PROVIDER)).strip()}
    quote = lambda v: '"' + "".join(c if c >= " " and c not in '"\\\x7f' else f"\\u{ord(c):04x}" for c in v) + '"'
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.writelines(f"{k} = {quote(v)}\n" for k, v in data.items())
    os.replace(f"{path}.new", path)
    return data


def allowed_overrides(engine: Column, values: Column) -> Column:
    """Of a map of overrides those that the engine takes and that say anything; an unknown engine takes the first one's."""
    allowed = F.coalesce(F.element_at(F.create_map(*[x for k, v in OVERRIDES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.coalesce(engine, F.lit("unlimited"))), F.array(*map(F.lit, OVERRIDES["unlimited"])))
    return F.map_filter(values, lambda k, v: F.array_contains(allowed, k) & v.isNotNull() & (v != ""))


def masked_view(provider: Column, base_url: Column, model: Column, key: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(F.coalesce(provider, F.lit(PROVIDER)).alias("provider"), text(base_url).alias("base_url"), text(model).alias("model"), mask(text(key)).alias("api_key_masked"), (text(key) != "").alias("has_api_key"))


def concurrency(asked: Column, most: int = 32) -> Column:
    """At least one worker; what a form may ask for is ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(F.nullif(asked, F.lit(0)), F.lit(1))))


def token_limit(asked: Column, most: int = MAX_TOKENS) -> Column:
    return F.least(asked, F.lit(most))
