"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

_UPPER = "".join(map(chr, range(65, 91)))
_WHITE = "\\x20\\x09-\\x0D"


def _leaf(text: str) -> str:
    parts = []
    for field in ("doc_id", "source", "lang", "n_chars", text):
        value = f"CAST({field} AS VARCHAR)"
        parts.append(f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END")
    return f"sha256({' || '.join(parts)})"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    byte = f"list_reduce(range(8), lambda c, bit: {step}, xor(crc, code))"
    return f"xor(list_reduce({codes}, lambda crc, code: {byte}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _reduced(name: str, levels: int) -> list[str]:
    """Runs of each level of ``name``0 (tree, pos, n, node), and the level above; a tree of one node stays as it is."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}_run{k} AS (SELECT tree, pos // 16 AS run, n, list(node ORDER BY pos) AS kids FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 16, n)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, sha256(array_to_string(kids, '')) AS node FROM {name}_run{k}"
            f" UNION ALL SELECT tree, pos, n, node FROM {name}{k} WHERE n <= 1)"
        )
    return out


def _proved(proof: int, name: str, levels: int) -> list[str]:
    """Proofs and folded nodes after each level of ``name``."""
    out = []
    for k in range(levels):
        before, after = "array_to_string(kids[1:p.pos % 16], '')", "array_to_string(kids[p.pos % 16 + 2:], '')"
        out.append(
            f"proof{proof + k + 1} AS (SELECT p.doc_id, p.leaf, p.source_no, p.tree, p.pos // 16 AS pos,"
            f" CASE WHEN kids IS NULL THEN p.proof ELSE p.proof || {before} || {after} END AS proof,"
            f" CASE WHEN kids IS NULL THEN p.folded ELSE sha256({before} || p.folded || {after}) END AS folded"
            f" FROM proof{proof + k} p LEFT JOIN {name}_run{k} r ON p.tree = r.tree AND p.pos // 16 = r.run)"
        )
    return out


def merkle_sql(inner: int = 6, upper: int = 4) -> str:
    """For sources of up to 16^``inner`` rows, and up to 16^``upper`` sources."""
    lowered = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END"
    parts = [
        f"claimed AS (SELECT doc_id, source, lang, n_chars, text, {lowered} AS claim FROM documents)",
        f"hashed AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf('claim')} AS claim FROM claimed)",
        "leaves AS (SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed)",
        "inner0 AS (SELECT tree, pos, n, leaf AS node FROM leaves)",
        *_reduced("inner", inner),
        f"upper0 AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM inner{inner}) AS n, node FROM inner{inner})",
        *_reduced("upper", upper),
        "proof0 AS (SELECT doc_id, leaf, tree AS source_no, tree, pos, '' AS proof, claim AS folded FROM leaves)",
        *_proved(0, "inner", inner),
        f"turned AS (SELECT doc_id, leaf, source_no, 0 AS tree, source_no AS pos, proof, folded FROM proof{inner})",
        *[part.replace(f"FROM proof{inner} p", "FROM turned p") for part in _proved(inner, "upper", upper)],
    ]
    return (
        f"WITH {', '.join(parts)} SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(p.proof) AS proof_sha256,"
        f" p.folded AS folded_root, p.folded = r.node AS verified FROM proof{inner + upper} p"
        f" JOIN inner{inner} s ON s.tree = p.source_no CROSS JOIN upper{upper} r"
    )


def fill_in_middle_sql(seed: int = 42, fim: int = 50, spm: int = 80) -> str:
    """The transformation of every document, with the text rebuilt from the output's own marks."""
    h = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]
    marked = " OR ".join(f"contains(t, '{mark}')" for mark in ("<P>", "<S>", "<M>"))
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    units AS (SELECT doc_id, t, regexp_extract_all(t, '[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+') AS u, {h[0]} AS h1, {h[1]} AS h2, {h[2]} AS h3, {h[3]} AS h4 FROM texts),
    cuts AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR {marked} OR h3 % 100 >= {fim} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units),
    parts AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts),
    outputs AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN o
            WHEN 'psm' THEN substr(o, 4, strpos(o, '<S>') - 4) || substr(o, strpos(o, '<M>') + 3) || substr(o, strpos(o, '<S>') + 3, strpos(o, '<M>') - strpos(o, '<S>') - 3)
            ELSE substr(o, strpos(o, '<P>') + 3, strpos(o, '<M>') - strpos(o, '<P>') - 3) || substr(o, strpos(o, '<M>') + 3) || substr(o, 4, strpos(o, '<P>') - 4)
        END) AS restored_sha256 FROM outputs"""
