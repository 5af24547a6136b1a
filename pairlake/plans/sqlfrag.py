r"""DuckDB SQL fragments mirroring the Column functions (oracle side only)."""

from __future__ import annotations

EXT_RE = r"(?s)\A(.*/)?\.*[^./][^/]*?(\.[^./]*)\z"

IMAGE_EXTS_SQL = None  # filled lazily from the Python list


def ext(p: str) -> str:
    return f"regexp_extract({p}, '{EXT_RE}', 2)"


def stem(p: str) -> str:
    return f"substr({p}, 1, length({p}) - length({ext(p)}))"


def norm(p: str) -> str:
    return f"replace({p}, '\\', '/')"


def top_dir(p: str) -> str:
    return f"(CASE WHEN instr({p}, '/') > 0 THEN split_part({p}, '/', 1) ELSE '' END)"


def extract_id(p: str) -> str:
    s = norm(stem(p))
    base = f"regexp_replace(regexp_extract({s}, '([^/]*)$', 1), '^(img-latents-|img)', '')"
    return f"(CASE WHEN instr({s}, '/') > 0 THEN regexp_extract({s}, '^(.*/)', 1) || {base} ELSE {s} END)"


def last_dot_ext(p: str) -> str:
    return f"lower(regexp_extract({p}, '([^.]*)$', 1))"


def image_exts() -> str:
    from pairlake.functions.paths import IMAGE_EXTS
    return "(" + ", ".join(f"'{e}'" for e in IMAGE_EXTS) + ")"


def supported_exts() -> str:
    from pairlake.functions.paths import IMAGE_EXTS, TENSOR_EXT
    return "(" + ", ".join(f"'{e}'" for e in IMAGE_EXTS + (TENSOR_EXT,)) + ")"


def hash_uniform(key_sql: str, seed: int = 0, i="'0'") -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', CAST({key_sql} AS VARCHAR), '{seed}', "
            f"CAST({i} AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0)")
