"""Secret scanning over an incremental ledger of content-addressed blobs, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import spans
from barloom.llm.common import settled

RULES_VERSION = 1
BASE = ["assign", "access", "hex"]
#: Fixed formats of well-known credentials that the method adds.
ADDED = {
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",  # not within a longer run, so no run is tried at each of its places
    "pem": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
}
KINDS = [*BASE, *ADDED]
#: What every match of a kind holds one of.
_MARKS = {"assign": ("=", ":"), "access": ("AKIA",), "jwt": ("eyJ",), "pem": ("-----BEGIN ",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "chat": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")}
_NAME = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"


def found_in(text: Column) -> Column:
    """All secrets of a text as an array of spans, by start, then kind as in KINDS.

    An assignment whose value has under 6 characters is dropped but still uses up its text, so it is
    matched with any length and filtered; a longest run of the other kinds' characters is kept or
    dropped whole, so their length is part of the pattern.
    """
    long_enough = lambda s: F.length(F.regexp_extract(s["found"], "^" + _ASSIGN, 1)) >= 6
    patterns = {"assign": _ASSIGN, "access": _ACCESS, "hex": _HEX, **ADDED}
    parts = {kind: spans.matches(text, kind, pattern, marks=_MARKS.get(kind, ())) for kind, pattern in patterns.items()}
    parts["assign"] = F.filter(parts["assign"], long_enough)
    return spans.ordered(reduce(F.concat, parts.values()), KINDS, by_kind=False)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules_version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger after this scan).

    versions: path, text, one row for each historical version; ledger: blob, rules_version, spans. A blob is
    the SHA-256 of a text (null: empty). Only blobs without a row of rules_version in the ledger are
    scanned, each once, whatever its number of paths; the others' findings are taken from the ledger. Of
    a blob's paths the smallest brings its text, and rows equal in path and text are one before they are dealt, so no copies
    meet in one task; findings return to the paths by a join with one row for each blob, which Spark splits where a blob has many paths.

    Returns path, blob, spans for each row of versions: repeated rows, null paths and texts without
    secrets (no spans) included. No rows: none, and the ledger as it was. Other columns of versions are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blob, name = F.sha2(F.encode(text, "UTF-8"), 256), F.coalesce(F.col("path").cast("string"), F.lit(""))
    paths = versions.select("path", blob.alias("blob"))
    unseen = versions.groupBy(blob.alias("blob")).agg(F.min(name).alias("name"))
    if ledger is not None:
        known = ledger.where(F.col("rules_version") == rules_version).select("blob").distinct()
        unseen = unseen.join(known, "blob", "left_anti")
    texts = versions.select(blob.alias("blob"), name.alias("name"), text.alias("text")).dropDuplicates(["blob", "name"])
    chosen = texts.join(unseen, ["blob", "name"], "left_semi")
    new = settled(chosen.select("blob", F.lit(rules_version).alias("rules_version"), found_in(F.col("text")).alias("spans")), "secret-ledger")
    full = new if ledger is None else ledger.select("blob", "rules_version", "spans").unionByName(new)
    hits = full.where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).select("blob", "spans")
    back = paths.join(hits, "blob", "left")
    return back.select("path", "blob", F.coalesce("spans", F.array().cast(f"array<{spans.SPAN}>")).alias("spans")), full


def _sql() -> str:
    """The rows of the query over documents in DuckDB SQL: places from interleaving matches and what is between."""
    patterns = {"assign": _ASSIGN, "access": _ACCESS, "hex": _HEX, **ADDED}
    patterns["jwt"] = patterns["jwt"].replace("(?<![A-Za-z0-9_-])", "(?:^|[^A-Za-z0-9_-])")  # no looking back there: what stands before is cut off below
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    parts = []
    for rank, (kind, p) in enumerate(quoted.items()):
        keep = f"len(regexp_extract(hit, '{p}', 1)) >= 6" if kind == "assign" else "true"
        led = " + length(hit) - length(regexp_replace(hit, '^[^A-Za-z0-9_-]', '')) AS start" if kind == "jwt" else ""
        parts.append(
            f"SELECT id, {rank} AS rank, '{kind}' AS kind, start{led}, start + length(hit) AS stop FROM (SELECT id, hit, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start "
            f"FROM (SELECT id, hits, gaps, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM t WHERE regexp_matches(text, '{p}')))) WHERE {keep}"
        )
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in BASE)
    text = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"
    return (
        "WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), found AS (" + " UNION ALL ".join(parts) + "), "
        f"per AS (SELECT id, {counts}, string_agg({text}) AS spans, string_agg({text}) FILTER (WHERE rank < {len(BASE)}) AS base FROM found GROUP BY id) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN per USING (id)"
    )


SQL = _sql()
