"""The queries that apply the corpus operators to the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    conversation_repair,
    decontamination,
    exact_dedup,
    jaccard_join,
    license_scan,
    mixing,
    quality_model,
    quality_rules,
    sharding,
    source_divergence,
    suffix_dedup,
    toxicity,
)
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), digests=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_byte_bpe, op3_jaccard_join, op4_quality_classifier, op5_exact_dedup, op6_license_scan, op7_source_mixing, op8_toxicity, op9_sharding, op10_quality_rules]
    found += [op11_source_divergence, op12_conversation_repair, op13_benchmark_decontamination]
    return {f.__name__: f for f in found}


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


def _sharding_sql() -> str:
    slots = sharding.lookup_table(sharding.shard_names())
    return f"""
SELECT doc_id, t[1 + ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {len(slots)}]::INTEGER AS shard
FROM documents, (SELECT {slots} AS t)"""


def _license_sql() -> str:
    """Containment of shingles of five words, or of a template's own length where it has fewer."""
    words = {name: license_scan.words_of(text) for name, text in license_scan.TEMPLATES.items()}
    length = {name: min(license_scan.SHINGLE, len(w)) for name, w in words.items()}
    listed = ", ".join(f"('{name}', '{' '.join(w[i : i + length[name]])}')" for name, w in words.items() for i in range(len(w) - length[name] + 1))
    marks = license_scan.PUNCTUATION.replace("'", "''")
    shingles = " UNION ".join(f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS s FROM w" for n in sorted(set(length.values())))
    return f"""
WITH t(license, s) AS (VALUES {listed}),
size AS (SELECT license, count(DISTINCT s) AS n FROM t GROUP BY license),
w AS (SELECT doc_id, list_filter(string_split(translate(lower(coalesce(text, '')), '{marks}', '{" " * len(license_scan.PUNCTUATION)}'), ' '), lambda x: x <> '') AS w FROM documents),
s AS ({shingles}),
hit AS (SELECT doc_id, license, count(DISTINCT s) AS c FROM s JOIN t USING (s) GROUP BY doc_id, license),
good AS (SELECT doc_id, license FROM hit JOIN size USING (license) WHERE c / n >= {license_scan.CONTAINMENT})
SELECT d.doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses
FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


def _mixing_sql() -> str:
    w = mixing.WEIGHTS
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  greatest(0.05, 1.0 - 5.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) / greatest(length(coalesce(text, '')), 1)) AS q,
  (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([{", ".join(map(str, w))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)}]::DOUBLE AS w, {mixing.CAP} * source_size AS cap, {mixing.BUDGET} * sum(source_size) OVER () AS total FROM src),
-- the level at which what is under its cap takes what those at their caps leave
lv AS (SELECT a.source, (any_value(a.total) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.source < a.source)), 0)) /
  sum(b.w) FILTER (NOT (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.source < a.source))) AS t FROM r a, r b GROUP BY a.source, a.cap, a.w),
t AS (SELECT arg_min(lv.t, cap / w) AS t FROM lv JOIN r ON lv.source IS NOT DISTINCT FROM r.source WHERE lv.t * w < cap),
p AS (SELECT source, source_size, least(cap, w * coalesce(t.t, 1e300)) AS target FROM r, t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id) - d.size / 2 AS middle FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM k"""


def _rules_sql() -> str:
    q = quality_rules
    p, ratio = q.ALPHA / len(q.RULES), {r: f"coalesce({x.split('/')[0]}::DOUBLE / nullif({x.split('/')[1]}, 0), 0)" for r, (x, _) in q.RULES.items()}
    steps = ", ".join(f"('{r}', {j}, {c})" for r, (_, ladder) in q.RULES.items() for j, c in enumerate(ladder))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in ratio.items()) + " END"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM tri WHERE c > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  length(text) - length(replace(text, '!', '')) AS n_bangs, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
step(rule, j, cut) AS (VALUES {steps}),
n AS (SELECT lang, rule, j, cut, count(*) AS n, count(*) FILTER ({value} > cut) AS k FROM f SEMI JOIN good USING (doc_id), step WHERE NOT base_failed GROUP BY lang, rule, j, cut),
tail AS (SELECT lang, rule, j, cut, CASE WHEN k > n * {p!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END AS p FROM n),
ok AS (SELECT *, bool_and(p <= {q.DELTA} / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM n) * {len(q.RULES)})) OVER (PARTITION BY lang, rule ORDER BY j) AS ok FROM tail),
cut AS (SELECT lang, rule, arg_max(cut, j) AS cut FROM ok WHERE ok GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM f JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang WHERE {value} > cut.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _divergence_sql() -> str:
    m = source_divergence
    share = lambda c, n: f"(1 + ({m.SCALE}::HUGEINT * ({c} + {m.PRIOR})) // ({n} + {m.PRIOR}::HUGEINT * v))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {m.MIN_DOCS}),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS group_n FROM g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(n.n, 0) AS c, {share("coalesce(n.n, 0)", "group_n")} AS p, {share("kept.total", "lang_n")} AS q
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= {m.TOP_TERMS}"""


def _repair_sql() -> str:
    """A recursion over turns that carries cost, audit and repaired text of the four states as they are."""
    m = conversation_repair
    names, far = {"u": "user", "a": "assistant"}, 10**12
    crc = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    state = lambda cost, audit, text: f"{{'c': {cost}, 'a': {audit}, 'r': {text}}}"
    column = dict(zip(m.STATES, ("sn", "ss", "su", "sa"), strict=True))

    def least(new: str) -> str:
        options = [state(f"p.{column[new]}.c + {m.DELETE}", f"p.{column[new]}.a || 'D'", f"p.{column[new]}.r")]
        for old in m.STATES if new != "-" else "":
            gap = m.BETWEEN.get(old + new)
            if gap is None:
                continue
            filled = "".join(f"chr(10) || '{names[x]}:' || " for x in gap)
            for edit, price, when, role in (("K", 0, f"x.ini = '{new}'", "x.role"), ("R", m.REROLE, "true", f"'{names.get(new)}'")):
                if edit == "R" and new == "s":
                    continue
                cost = f"CASE WHEN x.fault IN ('k', 't') AND {when} THEN p.{column[old]}.c + {m.INSERT * len(gap) + price} + CASE x.fault WHEN 't' THEN {m.TRUNCATED} ELSE 0 END ELSE {far} END"
                options.append(state(cost, f"p.{column[old]}.a || '{'I' * len(gap)}{edit}'", f"p.{column[old]}.r || {filled}chr(10) || {role} || ':' || x.text"))
        return f"list_sort([{', '.join(options)}])[1]"

    def end(old: str) -> str:
        filled = "".join(f" || chr(10) || '{names[x]}:'" for x in m.ENDING[old])
        return state(f"{column[old]}.c + {m.INSERT * len(m.ENDING[old])}", f"{column[old]}.a || '{'I' * len(m.ENDING[old])}'", f"{column[old]}.r{filled}")

    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
e AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS code FROM c, (SELECT {crc} AS t)),
r AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) FROM e WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
s AS (SELECT *, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM s),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS i, {", ".join(f"{state(f'{0 if x == "-" else far}::BIGINT', "''", "''")} AS {column[x]}" for x in m.STATES)} FROM z
  UNION ALL SELECT p.conv_id, p.i + 1, {", ".join(f"{least(x)} AS {column[x]}" for x in m.STATES)} FROM p JOIN f x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i + 1),
b AS (SELECT p.conv_id, list_sort([{", ".join(end(x) for x in m.STATES)}])[1] AS best FROM p JOIN z ON p.conv_id IS NOT DISTINCT FROM z.conv_id AND p.i = z.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _decontamination_sql() -> str:
    n = decontamination.WINDOW
    words = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words("text")} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {n}) AS k, array_to_string(w[p:p + least(len(w), {n}) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))),
m AS (SELECT id, item, k, p FROM g JOIN win USING (k, s)),
h AS (SELECT id, count(DISTINCT word) AS n FROM (SELECT id, unnest(range(p, p + k)) AS word FROM m) GROUP BY id),
t AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM m) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (id) LEFT JOIN t USING (id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d""",
        "op6_license_scan": _license_sql(),
        "op7_source_mixing": _mixing_sql(),
        "op10_quality_rules": _rules_sql(),
        "op9_sharding": _sharding_sql(),
        "op11_source_divergence": _divergence_sql(),
        "op12_conversation_repair": _repair_sql(),
        "op13_benchmark_decontamination": _decontamination_sql(),
    }
