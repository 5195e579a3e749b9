"""DuckDB SQL, put together from rules, that the manifest and the repair query are compared with."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    byte = "list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _levels(name: str, groups: str, depth: int) -> str:
    """Tables {name}0 ... {name}depth of nodes (groups, pos, n, d), and {name}s0 ... with the siblings of
    each node. {name}0 is given. `groups` is a column, or a constant for a single tree."""
    out = []
    for i in range(depth):
        run = f"PARTITION BY {groups}, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(
            f"""{name}s{i} AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
         CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r
  FROM {name}{i}),
{name}{i + 1} AS (
  SELECT {groups} AS g, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
         CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d
  FROM {name}{i} GROUP BY {groups}, pos // 8)"""
        )
    return ",\n".join(out)


def manifest_sql(depth: int = 8, group_depth: int = 3) -> str:
    """The manifest of `documents` for up to 8^depth rows of a language and 8^group_depth languages."""

    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        f"""d0 AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f
  FROM documents)""",
        """d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rn FROM d0)""",
        """t0 AS (SELECT g, rn AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM d)""",
        _levels("t", "g", depth),
        f"""u0 AS (SELECT g AS own, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d FROM t{depth})""",
        _levels("u", "g", group_depth),
        f"p0 AS (SELECT d.*, '' AS proof, t{depth}.d AS subroot FROM d JOIN t{depth} USING (g))",
    ]
    last, steps = "p0", [(f"ts{i}", "s.g = p.g", f"p.rn // {8**i}") for i in range(depth)]
    for i in range(group_depth):
        steps.append((f"us{i}", "true", f"p.place // {8**i}"))
    for i, (level, same, pos) in enumerate(steps, 1):
        if i == depth + 1:
            tables.append(f"q AS (SELECT p.*, u.pos AS place FROM {last} p JOIN u0 u ON u.own = p.g)")
            last = "q"
        tables.append(
            f"""p{i} AS (SELECT p.* REPLACE (p.proof || coalesce(s.l || s.r, '') AS proof,
  CASE WHEN s.n > 1 THEN sha256(s.l || p.f || s.r) ELSE p.f END AS f) FROM {last} p JOIN {level} s ON {same} AND s.pos = {pos})"""
        )
        last = f"p{i}"
    joined = ",\n".join(tables)
    return f"""WITH {joined}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified
FROM {last}, u{group_depth} r"""


def repair_sql() -> str:
    """Damage, faults and the cheapest edits of `conversations`: the best (cost, audit, repaired text) of each
    of the four states is carried over the rows of a conversation."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    draw = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")

    def step(state: str, cost: str, letter: str, role: str = "", text: str = "") -> str:
        said = f" || chr(10) || {role} || ':' || {text}" if role else ""
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{said}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def insert(state: str, role: str) -> str:
        return step(state, "5", "I", f"'{role}'", "''")

    # a chain of inserts has one or two links
    filled = f"""[v[1], v[2],
      {least("v[3]", insert("v[1]", "user"), insert("v[2]", "user"), insert("v[4]", "user"))},
      {least("v[4]", insert("v[3]", "assistant"), insert(f"({insert('v[1]', 'user')})", "assistant"), insert(f"({insert('v[2]', 'user')})", "assistant"))}]"""

    def then(i: int, state: str, initial: str, role: str) -> str:
        keep = step(f"v[{i}]", "x.late", "K", "x.role", "x.text")
        rerole = step(f"v[{i}]", "x.late + 1", "R", f"'{role}'", "x.text")
        return f"CASE WHEN x.gone THEN {{'c': 1000000, 'a': '', 't': ''}} WHEN x.i = '{initial}' THEN {keep} ELSE {rerole} END"

    never = "{'c': 1000000, 'a': '', 't': ''}"
    deletes = [step(f"v[{i}]", "2", "D") for i in range(1, 5)]
    system = f"CASE WHEN NOT x.gone AND x.i = 's' THEN {step('v[1]', 'x.late', 'K', 'x.role', 'x.text')} ELSE {never} END"
    row = f"""[{deletes[0]}, {least(deletes[1], system)},
      {least(deletes[2], *[then(i, "u", "u", "user") for i in (1, 2, 4)])},
      {least(deletes[3], then(3, "a", "a", "assistant"))}]"""
    return f"""WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {draw} % 20 AS k FROM conversations),
e AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d WHERE k <> 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS pos, rtrim(text, {blanks}) AS s,
         substr(role, 1, 1) AS i0 FROM e),
f AS (
  SELECT *, CASE WHEN s = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         CASE WHEN pos > 1 THEN lag(i0) OVER (PARTITION BY conv_id ORDER BY pos) || i0 END AS pair FROM p),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
rows_of AS (
  SELECT conv_id, pos, {{'i': i0, 'role': role, 'text': text, 'gone': coalesce(fault IN ('blank', 'duplicate'), false),
         'late': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} AS x FROM f),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, [{{'c': 0, 'a': '', 't': ''}}, {never}, {never}, {never}] AS v FROM g
  UNION ALL
  SELECT conv_id, pos, {row} AS v
  FROM (SELECT w.conv_id, r.pos, r.x, {filled} AS v FROM w JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1)),
b AS (
  SELECT conv_id, list_sort([v[1], v[4]])[1] AS best
  FROM (SELECT w.conv_id, {filled} AS v FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.pos))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
