"""The registered queries of this package and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bagweave.llm import chat, collocations, decontamination, html_text, jaccard, mixing, packing, quality_knn, quality_rules, repair, secrets, suffixes, warc
from bagweave.llm.common import fresh_dir, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digest(chat.format_chat(rows))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_quality_classifier, op3_benchmark_decontamination, op4_suffix_array_dedup, op5_ngram_jaccard_join, op6_warc, op7_chat_formatting, op8_quality_rules, op9_source_mixing, op10_html_extraction,
    op11_best_fit_packing, op12_conversation_repair, op13_phrase_collocations,
)}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The distinct shingles of five words of each row (fewer words: one shingle), for a table with an id and a text.
SHINGLES = """{name}_w AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
{name} AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {name}_w)"""
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_fill = {"upper": LETTERS, "lower": LETTERS.lower()}

#: Cost (nine digits) and audit of a path as one string that sorts like them; an edit adds to both.
_edit = lambda path, cost, letter: f"lpad(CAST(CAST(substr({path}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{letter}'"
_insert = lambda path: "(" + _edit(path, repair.INSERT, "I") + ")"
_twice = lambda path: _insert(_insert(path))
_keep = lambda path, initial: f"CASE WHEN fault > 1 AND ini = '{initial}' THEN {_edit(path, f'CASE WHEN fault = 2 THEN {repair.TRUNCATED} ELSE 0 END', 'K')} END"
_turn = lambda path, initial: f"CASE WHEN fault <= 1 THEN NULL WHEN ini = '{initial}' THEN {_edit(path, f'CASE WHEN fault = 2 THEN {repair.TRUNCATED} ELSE 0 END', 'K')} ELSE {_edit(path, f'CASE WHEN fault = 2 THEN {repair.TRUNCATED} ELSE 0 END + {repair.REROLE}', 'R')} END"
_delete = lambda path: _edit(path, repair.DELETE, "D")

ORACLES: dict[str, str] = {
    "op12_conversation_repair": f"""WITH RECURSIVE t AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_concat([CAST(b AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c // 256, tab[CAST(xor(c % 256, x) + 1 AS BIGINT)])), 4294967295) % 20 AS f FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, (VALUES (1), (2)) v(c) WHERE f > 0 AND (c = 1 OR f = 3)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) AS same, substr(role, 1, 1) AS ini FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM d)),
x AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY nth) || ini AS two, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 0 WHEN same > 1 THEN 1 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 2 ELSE 3 END AS fault FROM g),
r(conv_id, nth, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM conversations
UNION ALL SELECT conv_id, nth, {_delete("e0")}, least({_delete("s1")}, {_keep("e0", "s")}), least({_delete("e2")}, {_turn("e0", "u")}, {_turn("s1", "u")}, {_turn("e3", "u")}), least({_delete("e3")}, {_turn("e2", "a")}) FROM (SELECT r.conv_id, x.nth, fault, ini, s0 AS e0, s1, least(s2, {_insert("s0")}, {_insert("s1")}, {_insert("s3")}) AS e2, least(s3, {_insert("s2")}, {_twice("s0")}, {_twice("s1")}) AS e3
FROM r JOIN x ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND x.nth = r.nth + 1)),
b AS (SELECT conv_id, least(s0, s3, {_insert("s2")}, {_twice("s1")}) AS k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nth DESC) AS back FROM r) WHERE back = 1), c AS (SELECT conv_id, CAST(substr(k, 1, 9) AS BIGINT) AS cost, substr(k, 10) AS audit FROM b),
l AS (SELECT conv_id, p, e, CAST(count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS BIGINT) AS nth FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM c WHERE audit <> '')),
o AS (SELECT l.conv_id, p, e, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) - max(CASE WHEN e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS k FROM l LEFT JOIN x ON l.conv_id IS NOT DISTINCT FROM x.conv_id AND l.nth = x.nth AND e <> 'I' WHERE e <> 'D'),
y AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM o GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM c LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN y ON c.conv_id IS NOT DISTINCT FROM y.conv_id""",
    "op13_phrase_collocations": f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang), g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {collocations.LEAST}), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM s) WHERE nth = 1), o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) v(m) WHERE m < k) GROUP BY ALL)
SELECT * FROM (SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS BIGINT) AS rank, b.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < {collocations.COVERED} * a) WHERE rank <= {collocations.TOP}""",
    "op1_secret_scans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k(kind, rk, pat) AS (VALUES ('assign', 0, {_quoted(secrets.ASSIGN)}), ('access', 1, {_quoted(secrets.ACCESS)}), ('hex', 2, {_quoted(secrets.HEX)}), ('run', 3, {_quoted(secrets.CANDIDATE)})),
l AS (SELECT doc_id, kind, rk, string_split_regex(t, pat) AS gaps, regexp_extract_all(t, pat, 0) AS wholes, CASE WHEN kind = 'assign' THEN regexp_extract_all(t, pat, 2) ELSE regexp_extract_all(t, pat, 0) END AS vals FROM d, k), m AS (SELECT doc_id, kind, rk, unnest(gaps) AS gap, unnest(wholes) AS whole, unnest(vals) AS val, generate_subscripts(gaps, 1) AS nth FROM l WHERE len(wholes) > 0),
s AS (SELECT *, sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS stop FROM m), f AS (SELECT doc_id, kind, rk, CAST(stop - length(whole) AS BIGINT) AS begin, CAST(stop AS BIGINT) AS stop, whole FROM s WHERE whole IS NOT NULL AND (kind <> 'assign' OR length(val) >= 6)),
base AS (SELECT * FROM f WHERE rk < 3), covered AS (SELECT DISTINCT doc_id, unnest(range(begin, stop)) AS pos FROM base), chars AS (SELECT doc_id, begin AS run, unnest(range(begin, stop)) AS pos, unnest(string_split(whole, '')) AS ch FROM f WHERE rk = 3),
free AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS isle FROM chars ANTI JOIN covered USING (doc_id, pos)), rem AS (SELECT doc_id, min(pos) AS begin, max(pos) + 1 AS stop, string_agg(ch, '' ORDER BY pos) AS v FROM free GROUP BY doc_id, run, isle HAVING count(*) >= {secrets.WINDOW}),
c AS (SELECT * FROM rem WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, {_quoted("|".join(secrets.ALLOW))}) AND NOT regexp_full_match(v, '/?(?:[A-Za-z]+[0-9]{{0,4}}[/_-])+(?:[A-Za-z]+[0-9]{{0,4}}|[0-9]{{1,4}})?')),
w AS (SELECT doc_id, begin, stop, v, k, substr(v, k + 1, {secrets.WINDOW}) AS w FROM (SELECT *, unnest(range(0, length(v) - {secrets.WINDOW - 1})) AS k FROM c)), g AS (SELECT doc_id, begin, stop, v, k, ch, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS ch FROM w WHERE NOT regexp_matches(w, '{"|".join(secrets.LITERALS)}')) GROUP BY ALL),
e AS (SELECT doc_id, begin, stop, v, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} AS bits FROM g GROUP BY doc_id, begin, stop, v, k), high AS (SELECT DISTINCT doc_id, 'entropy' AS kind, 3 AS rk, begin, stop FROM e WHERE bits >= CASE {" ".join(f"WHEN regexp_matches(v, '{p}') THEN {b}" for p, b in secrets.CLASSES.values())} END),
spans AS (SELECT doc_id, kind, rk, begin, stop FROM base UNION ALL SELECT * FROM high) SELECT d.doc_id, CAST(count(*) FILTER (rk = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (rk = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (rk = 2) AS BIGINT) AS n_hex,
sha256(coalesce(string_agg(kind || ':' || begin || ':' || stop, ',' ORDER BY begin, rk) FILTER (rk < 3), '')) AS base_sha256, coalesce(string_agg(kind || ':' || begin || ':' || stop, ',' ORDER BY begin, rk), '') AS spans FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id""",
    "op3_benchmark_decontamination": f"""WITH {SHINGLES.format(name="d", id="doc_id", table="documents", **_fill)}, {SHINGLES.format(name="q", id="item_id", table="benchmark", **_fill)}, n AS (SELECT id, count(*) AS n FROM q GROUP BY id),
p AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS k FROM d JOIN q ON d.s = q.s GROUP BY 1, 2) SELECT doc_id, item_id, CAST(k AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_item, k / CAST(n AS DOUBLE) AS containment FROM p JOIN n ON n.id = item_id WHERE k >= .75 * n""",
    "op7_chat_formatting": """WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS t, length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) AS o, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(CASE WHEN before = role THEN 8 + t ELSE 23 + o + t END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op4_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1), b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM a),
c AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b), r AS (SELECT doc_id, min(i) AS begin, max(i) + 100 AS stop FROM c GROUP BY doc_id, run), k AS (SELECT doc_id, begin, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY begin), 0) AS before FROM r),
p AS (SELECT doc_id, begin AS o, substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (begin - before) AS BIGINT)) AS piece FROM k JOIN d USING (doc_id) UNION ALL SELECT doc_id, 9223372036854775807, substr(h, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)) FROM d LEFT JOIN (SELECT doc_id, max(stop) AS stop FROM r GROUP BY doc_id) USING (doc_id)),
q AS (SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY o))) AS kept FROM p GROUP BY doc_id), n AS (SELECT doc_id, sum(stop - begin) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, kept AS kept_sha256 FROM d JOIN q USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""WITH RECURSIVE {SHINGLES.format(name="d", id="doc_id", table="documents", **_fill)}, n AS (SELECT id, count(*) AS n FROM d GROUP BY id), x AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)), v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v.b, c.root FROM c JOIN v ON v.a = c.id WHERE c.root < v.b)
SELECT c.id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON n.id = c.id GROUP BY c.id""",
    "op8_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)), y AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM v) WHERE k > 1), p AS (SELECT doc_id, count(DISTINCT place) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM y) GROUP BY doc_id),
a AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
r AS (SELECT *, [n_symbols / CAST(greatest(n_words, 1) AS DOUBLE), n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE), n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE), n_upper / CAST(greatest(word_chars, 1) AS DOUBLE)] AS rates, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 2 AS half FROM a),
g AS (SELECT * FROM r WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)), lv(i, level) AS (VALUES {", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(quality_rules.LEVELS))}),
c AS (SELECT lang, i, [list_sort(list(rates[1]))[k], list_sort(list(rates[2]))[k], list_sort(list(rates[3]))[k], list_sort(list(rates[4]))[k]] AS cut FROM (SELECT lang, i, rates, CAST(greatest(1, ceil((1 - level) * count(*) OVER (PARTITION BY lang, i))) AS BIGINT) AS k FROM g, lv WHERE half = 0) GROUP BY lang, i, k),
x AS (SELECT lang, i, any_value(cut) AS cut, count(*) AS n, count(*) FILTER (rates[1] > cut[1] OR rates[2] > cut[2] OR rates[3] > cut[3] OR rates[4] > cut[4]) AS k FROM g JOIN c USING (lang) WHERE half = 1 GROUP BY lang, i), q AS (SELECT count(DISTINCT lang) AS strata FROM x),
b AS (SELECT lang, i, cut, strata, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END + j * ln({quality_rules.ALPHA}) + (n - j) * ln(1 - {quality_rules.ALPHA})))) AS chance FROM x, q),
o AS (SELECT lang, i, cut, bool_and(chance <= {quality_rules.DELTA} / strata) OVER (PARTITION BY lang ORDER BY i) AS passes FROM b), m AS (SELECT lang, arg_max(cut, i) AS cut FROM o WHERE passes GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(rates[1] > cut[1] OR rates[2] > cut[2] OR rates[3] > cut[3] OR rates[4] > cut[4], false) AS kept FROM r LEFT JOIN m USING (lang)""",
    "op9_source_mixing": """WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws(':', '0', doc_id, md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source), w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW q AS (ORDER BY cap / weight, source IS NULL, source)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT max(level) FROM o WHERE level <= cap / weight), 0)) AS target FROM o), x AS (SELECT z.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(coalesce(budget // nullif(source_size, 0), 0) * size + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before)) AS BIGINT) AS taken FROM x""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h), x AS (SELECT page_id, first_id, octet_length(encode(p.h)) AS n, sha1(p.h) AS d FROM p JOIN f ON p.h = f.h),
b AS (SELECT page_id, first_id, n, list_reduce(list_transform(range(1, 33), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(d, 1 + ((5 * (i - 1)) // 4), 2) || CASE WHEN (5 * (i - 1)) // 4 = 39 THEN '0' ELSE '' END)::BIGINT >> (3 - (5 * (i - 1)) % 4)) & 31 AS BIGINT), 1)), lambda u, v: u || v) AS digest FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM b""",
}
