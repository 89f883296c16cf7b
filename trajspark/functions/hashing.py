"""Stable hashes, seeded draws, folds, digests and fingerprints (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts: Column | str | int, sep: str) -> Column:
    return F.concat_ws(sep, *[
        (p if isinstance(p, Column) else F.lit(str(p))).cast("string")
        for p in parts])


def uniform(seed: str | int, *keys: Column) -> Column:
    """Uniform draw in [0, 1) keyed by (seed, keys): 52 bits of SHA-256.

    The draw depends on the keys only, never on a row's position, so a lost
    task draws the same numbers again.
    """
    h = F.sha2(_text(seed, *keys, sep=":"), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def stable_int(*keys: Column | str, mod: int) -> Column:
    """Stable non-negative integer below ``mod``."""
    h = F.sha2(_text(*keys, sep=":"), 256)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(mod))


def fold_of(episode_id: Column, k: int, salt: str = "") -> Column:
    """Fold of an episode from its id alone: first 8 bytes of SHA-256 mod k."""
    h = F.sha2(_text(salt, episode_id, sep=":"), 256)
    n = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    return (n % F.lit(k)).cast("int")


def digest(text: Column) -> tuple[Column, Column]:
    """Privacy digest: character count and the first 16 hex digits."""
    t = F.coalesce(text, F.lit(""))
    return F.length(t), F.substring(F.sha2(t, 256), 1, 16)


def lf_digest(text: Column) -> Column:
    """SHA-256 of a text after CRLF and lone CR became LF."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def fingerprint(**fields: Column) -> Column:
    """SHA-256 over named fields, in name order."""
    s = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.sha2(s, 256)


def rounded_text(x: Column, places: int = 6) -> Column:
    """A number as fixed text, with -0.0 written like 0.0."""
    return F.format_string(f"%.{places}f", F.round(x, places) + F.lit(0.0))
