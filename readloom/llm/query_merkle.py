"""op11: the manifest of all documents, and a check of tampered ones."""

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .merkle import merkle_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every third id, by its checksum, the text is claimed to be lower-case."""
    docs = util.read(spark, sf_dir, "documents").select(COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest(docs, COLUMNS, changed=tampered, changes={"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)})


def _sql(levels: int = 9) -> str:
    """SQL for trees of up to 8 ** levels leaves: a level is a table of (g, pos, h, n, lang)."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"
    byte = "list_transform(range(8), lambda k: 1)"
    step = f"list_reduce(list_prepend(xor(c, b), {byte}), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: {step}), 4294967295)"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"f AS (SELECT doc_id, lang, {hashed('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS claim FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f)",
        "l0 AS (SELECT lang AS g, pos, leaf AS h, n FROM a0)",
    ]
    up = lambda new, old: f"{new} AS (SELECT g, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (n + 7) // 8 AS n FROM {old} WHERE n > 1 GROUP BY g, pos // 8, n)"
    parts += [up(f"l{k + 1}", f"l{k}") for k in range(levels)]
    tops = " UNION ALL ".join(f"SELECT g, h FROM l{k} WHERE n = 1" for k in range(levels + 1))
    parts += [f"tops AS ({tops})", "t0 AS (SELECT NULL AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, g AS lang FROM tops)"]
    parts += [up(f"t{k + 1}", f"t{k}") for k in range(3)]
    roots = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(4))
    # each row goes up: its siblings are appended, its claim is folded with them
    parts.append("p0 AS (SELECT doc_id, lang AS g, pos, n, leaf, claim AS fold, '' AS proof, pos AS row_pos FROM a0)")
    level = lambda new, old, nodes, g: f"""{new} AS (SELECT p.doc_id, p.g, p.leaf, p.row_pos, any_value(p.pos) // 8 AS pos, (any_value(p.n) + 7) // 8 AS n,
        CASE WHEN any_value(p.n) = 1 THEN any_value(p.fold) ELSE sha256(string_agg(CASE WHEN x.pos = p.pos THEN p.fold ELSE x.h END, '' ORDER BY x.pos)) END AS fold,
        any_value(p.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> p.pos AND p.n > 1), '') AS proof
        FROM {old} p LEFT JOIN {nodes} x ON {g} AND x.pos // 8 = p.pos // 8 GROUP BY p.doc_id, p.g, p.leaf, p.row_pos)"""  # noqa: E731
    parts += [level(f"p{k + 1}", f"p{k}", f"l{k}", "x.g IS NOT DISTINCT FROM p.g") for k in range(levels)]
    parts.append(f"q0 AS (SELECT p.* REPLACE (t.pos AS pos, t.n AS n), t.h AS subroot FROM p{levels} p JOIN t0 t ON t.lang IS NOT DISTINCT FROM p.g)")
    parts += [level(f"q{k + 1}", f"q{k}", f"t{k}", "true").replace("AS proof\n", "AS proof, any_value(p.subroot) AS subroot\n") for k in range(3)]
    return f"""WITH {", ".join(parts)}, root AS ({roots})
        SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified FROM q3, root"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
#: Up to 8 ** 5 documents a language.
ORACLES = {"op11_merkle_manifest": _sql(5)}
