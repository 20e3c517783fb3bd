"""SQL (DuckDB) for the corpus queries that it can express."""

from __future__ import annotations

from sigweave.llm.licenses import COPYRIGHT_LINE, NOT_WORD, SPELLINGS, known_texts
from sigweave.llm.quality import BITS, FENCES, INNER, MIN_WORDS, OUTER, PRIOR, REPEAT_PERCENT

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) m ON m.node = d.doc_id
"""


def _bucket(v: str) -> str:
    n, octave = 1 << BITS, f"(length(bin(CAST({v} AS BIGINT))) - {BITS + 1})"
    return f"CASE WHEN {v} < {2 * n} THEN {v} ELSE {n} * {octave} + ({v} // (1::BIGINT << greatest(0, {octave}))) END"


def _value(b: str) -> str:
    n = 1 << BITS
    return f"CASE WHEN {b} < {2 * n} THEN {b} ELSE ({n} + {b} % {n}) * (1::BIGINT << greatest(0, {b} // {n} - 1)) END"


def _quality() -> str:
    measures = {m: f"{scale} * {count} // {size}" for m, (scale, count, size, *_) in FENCES.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_bucket('(' + x + ')')} AS bucket FROM st WHERE NOT base_failed AND n_lines > 0 AND word_chars > 0" for m, x in measures.items())
    ends = {"mid": _value("qm"), "mid_end": _value("(qm + 1)") + " - 1", "low": _value("ql"), "high_end": _value("(qh + 1)") + " - 1"}

    def level(name: str, keys: str) -> str:
        comma = keys + ", " if keys else ""
        values = ", ".join(f"CAST(({x}) AS DOUBLE) AS {c}" for c, x in ends.items())
        return f"""{name}0 AS (SELECT {comma}measure, bucket, count(*) AS n FROM sk GROUP BY ALL), {name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {comma}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {comma}measure) AS rows FROM {name}0),
{name}2 AS (SELECT {comma}measure, max(rows) AS rows, min(bucket) FILTER (run >= rows * 0.5) AS qm, min(bucket) FILTER (run >= rows * {INNER}) AS ql, min(bucket) FILTER (run >= rows * {OUTER}) AS qh FROM {name}1 GROUP BY ALL),
{name} AS (SELECT {comma}measure, CAST(rows AS DOUBLE) * CAST(rows AS DOUBLE) AS rows, {values} FROM {name}2)"""

    prior = f"CAST({PRIOR**2} AS DOUBLE)"
    lean = lambda t, c, on: f"({t}.rows * {t}.{c} + {prior} * {on}) / ({t}.rows + {prior})"
    case = lambda i: "CASE measure " + " ".join(f"WHEN '{m}' THEN {f[i]}" for m, f in FENCES.items()) + " END"
    fence = lambda side, m: f"(SELECT {side} FROM fe WHERE fe.lang IS NOT DISTINCT FROM st.lang AND fe.source IS NOT DISTINCT FROM st.source AND measure = '{m}')"
    bad = " OR ".join(
        f"coalesce({scale} * {count} - {scale * spare} > {fence('high', m)} * {size}, false)" + (f" OR coalesce({scale} * {count} + {scale * spare} < {fence('low', m)} * {size}, false)" if is_low else "")
        for m, (scale, count, size, _, spare, _, is_low) in FENCES.items()
    )
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)
), gd AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1
), rp AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM gd) GROUP BY 1
), ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1
), st AS (
  SELECT doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines,
    CASE WHEN len(w) > 1 THEN len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) ELSE 0 END AS n_stutter,
    len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(w) AS base_failed
  FROM w LEFT JOIN rp USING (doc_id) LEFT JOIN ln USING (doc_id)
), sk AS ({rows}), {level("la", "lang, source")}, {level("lb", "lang")}, {level("lc", "")},
ce AS (
  SELECT a.lang, a.source, a.measure, {", ".join(lean("a", c, lean("b", c, "c." + c)) + f" AS {c}" for c in ends)}
  FROM la a JOIN lb b ON b.lang IS NOT DISTINCT FROM a.lang AND b.measure = a.measure JOIN lc c ON c.measure = a.measure
), fe AS (
  SELECT lang, source, measure, mid + greatest({case(3)} * (high_end - mid), mid / {1 << BITS} + 1) AS high, mid - greatest({case(3)} * (mid_end - low), mid / {1 << BITS} + 1) AS low FROM ce
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT CASE WHEN n_words > 0 AND n_lines > 0 AND word_chars > 0 THEN {bad} ELSE false END AS kept FROM st
"""


OP3 = f"""
WITH w AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM dup)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _licenses() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        x = f"regexp_replace(lower({x}), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        for one, other in SPELLINGS:
            x = f"replace({x}, {quote(one)}, {quote(other)})"
        return f"trim(regexp_replace({x}, {quote(NOT_WORD)}, ' ', 'g'))"

    digest = lambda x: f"CASE WHEN {canonical(x)} <> '' THEN sha256({canonical(x)}) END"
    known = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in known_texts())
    return f"""
WITH k AS (
  SELECT min(license) AS license, {digest("text")} AS digest FROM (VALUES {known}) v(license, text) GROUP BY 2
), li AS (
  SELECT doc_id, k.license FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x JOIN k ON k.digest = {digest("x.line")}
), nt AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM li GROUP BY 1
), dd AS (
  SELECT doc_id, {digest("text")} AS digest FROM documents
)
SELECT doc_id, dd.digest, k.license, coalesce(notices, '') AS notices FROM dd LEFT JOIN k USING (digest) LEFT JOIN nt USING (doc_id)
"""


OP7 = r"""
WITH t AS (
  SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, replace(coalesce(role, ''), '<|', '<\|'), replace(coalesce(text, ''), '<|', '<\|')) AS pos, replace(coalesce(role, ''), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations WHERE conv_id IS NOT NULL
), f AS (
  SELECT pair_id, min(pos) AS first FROM (SELECT pair_id, pos, count(*) = 2 AND min((role, text)) = max((role, text)) AS same FROM t GROUP BY 1, 2) WHERE NOT same GROUP BY 1
), p AS (
  SELECT t.*, coalesce(pos < first, true) AS in_prompt, '<|' || role || '|>' || chr(10) || text || chr(10) AS piece FROM t LEFT JOIN f USING (pair_id)
), q AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side, in_prompt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS start, min(side) OVER (PARTITION BY pair_id) AS one FROM p
)
SELECT pair_id, CAST(coalesce(max(pos) FILTER (in_prompt), 0) AS BIGINT) AS n_prompt_turns, coalesce(string_agg(piece, '' ORDER BY pos) FILTER (in_prompt AND side = one), '') AS prompt,
  CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(piece, '' ORDER BY pos) FILTER (side = 0 AND NOT in_prompt), '') END AS chosen,
  CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 1 AS BIGINT), ',' ORDER BY pos) FILTER (side = 0 AND NOT in_prompt AND role = 'assistant'), '') END AS chosen_mask,
  CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(piece, '' ORDER BY pos) FILTER (side = 1 AND NOT in_prompt), '') END AS rejected,
  CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 1 AS BIGINT), ',' ORDER BY pos) FILTER (side = 1 AND NOT in_prompt AND role = 'assistant'), '') END AS rejected_mask
FROM q GROUP BY 1
"""

_ALNUM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""
WITH d AS (
  SELECT doc_id, {_ALNUM.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents
), b AS (
  SELECT item_id, {_ALNUM.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON bw.s = dw.s AND bw.size = dw.size
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY 1
), it AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (
  SELECT doc_id, {_TERMS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format(text=_LOWER.format(text="coalesce(text, '')"))}) AS term FROM benchmark
), t AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2
), s AS (
  SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), wt AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s
), p AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n) // l)) AS impact FROM t JOIN d USING (doc_id), s
), sc AS (
  SELECT item_id, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN wt USING (term) JOIN p USING (term) GROUP BY 1, 2
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
SQL = {"op1_ngram_join": OP1, "op2_quality": _quality(), "op3_substring_dedup": OP3, "op6_licenses": _licenses(), "op7_preferences": OP7, "op9_decontamination": OP9, "op13_lexical_search": OP13}
