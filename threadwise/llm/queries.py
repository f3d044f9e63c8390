"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.llm import arc, collocations, fst_count, imatch, mixing, packing, periodic_runs, quality_rules, simhash_trie, suffix_dedup, token_frames, url_rules, voronoi_join
from threadwise.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


# ---------------------------------------------------------------- 1 quality rules


#: Texts of so many words are judged by their words, however few of them are common.
JUDGED_WORDS = 100


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "lang", "text"), judged_words=JUDGED_WORDS)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _op1_sql() -> str:
    limits, known = quality_rules.Limits(), quality_rules.vocabulary()
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    spelt = quoted([*known, *{w.capitalize() for w in known}, *{w.upper() for w in known if len(w) > 1}])
    langs, space, k = quoted(quality_rules.COMMON_WORDS), r"\x20\x09-\x0D", limits.window
    gone = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    half = lambda x, m: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END)"
    part = f"({half('p', '((p + r) / 2)')} + {half('r', '((p + r) / 2)')})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{space}]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
m AS (SELECT *, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        {gone('[^A-Z]+')} AS up, {gone('[^0-9]+')} AS dig, {gone(r'[\x00-\x7F]+')} AS far,
        {gone(r'[a-zA-Z0-9' + space + r'#*$%&|<>]|[^\x00-\x7F]')} AS oth FROM w),
tok AS (SELECT rid, lang, n_words, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM m),
win AS (SELECT rid, i, list(x) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS g FROM tok),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE len(g) = {k}) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + z) AS n_repeat_words FROM rep, range({k}) AS r(z) GROUP BY 1),
cls AS (SELECT rid, lang, n_words, unnest(cl) AS n, generate_subscripts(cl, 1) AS c FROM (
  SELECT *, [length(t) - up - dig - (length(t) - word_chars) - n_symbols - far - oth, up, dig, length(t) - word_chars, n_symbols, far, oth] AS cl FROM m)),
com AS (SELECT rid, lang, n_words, lower(x) AS w, count(*) AS n FROM tok WHERE x IN ({spelt}) GROUP BY ALL),
cref AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS r FROM cls WHERE n_words >= {limits.min_words} AND lang IN ({langs}) GROUP BY lang, c),
wref AS (SELECT lang, w, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS r FROM com WHERE n_words >= {limits.min_words} AND lang IN ({langs}) GROUP BY lang, w),
cp AS (SELECT rid, c, n / sum(n) OVER (PARTITION BY rid) AS p, sum(n) OVER (PARTITION BY rid) AS n_chars FROM cls),
cd AS (SELECT rid, any_value(n_chars) AS n_chars, sqrt(greatest(0, sum({part}) / 2)) AS dist FROM cp JOIN cref USING (c) WHERE n_chars > 0 GROUP BY rid, lang),
cm AS (SELECT rid, any_value(n_chars) AS n_chars, min(dist) AS char_distance FROM cd GROUP BY 1),
wp AS (SELECT rid, w, n / sum(n) OVER (PARTITION BY rid) AS p, sum(n) OVER (PARTITION BY rid) AS n_common FROM com),
wl AS (SELECT wp.*, l.lang, coalesce(wref.r, 0) AS r FROM wp CROSS JOIN (SELECT DISTINCT lang FROM cref) l LEFT JOIN wref ON wref.lang = l.lang AND wref.w = wp.w),
wd AS (SELECT rid, any_value(n_common) AS n_common, sqrt(greatest(0, (sum({part} - r) + 1) / 2)) AS dist FROM wl GROUP BY rid, lang),
wm AS (SELECT rid, any_value(n_common) AS n_common, min(dist) AS word_distance FROM wd GROUP BY 1),
f AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_rep, n_words < {limits.min_words} OR 100 * coalesce(n_repeat_words, 0) > {limits.max_repeat_percent} * n_words AS base_failed,
        n_chars, char_distance, n_common, word_distance FROM m LEFT JOIN cov USING (rid) LEFT JOIN cm USING (rid) LEFT JOIN wm USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {limits.min_chars} AND char_distance > {limits.max_char_distance}, false)
    AND NOT coalesce((coalesce(n_common >= {limits.min_common}, false) OR n_words >= {JUDGED_WORDS}) AND coalesce(word_distance, 1) > {limits.max_word_distance}, false) AS kept,
  round(char_distance, 6) AS char_distance, round(coalesce(word_distance, 1), 6) AS word_distance
FROM f"""


# ---------------------------------------------------------------- 2 repeated passages


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# ---------------------------------------------------------------- 4 near-duplicates


def op4_simhash_trie(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 3 packing


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_file(WORD_BPE), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# ---------------------------------------------------------------- 5 fingerprints


def op5_imatch(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 6 token files


def op6_token_frames(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_frames.write_tokens(table(spark, sf, "documents"), tokenizer_file(WORD_BPE), end_id=1)
    return token_frames.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# ---------------------------------------------------------------- 7 mixing


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    narrow = docs.withColumn("size", mixing.count_words(F.col("text"))).drop("text")
    return mixing.mix(narrow, text_col="").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, 'null'))) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap,
        (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE
          / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM s WINDOW before AS (ORDER BY (2 * source_size) / w::DOUBLE, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, cap,
        CASE WHEN cap > level * w THEN max(CASE WHEN cap > level * w THEN level END) OVER () * w ELSE cap::DOUBLE END AS target FROM r),
g AS (SELECT *, least(round(target)::BIGINT, cap) AS goal FROM t),
p AS (SELECT row_number() OVER () AS rid, d.*, g.source_size, g.target, g.goal,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
-- golden-ratio points through the cumulative goals; the r-th slot of a source takes its r-th block
c AS (SELECT source, ceil(goal / {mixing.BLOCK}::DOUBLE)::BIGINT AS need,
        floor(sum(goal) OVER (ORDER BY source NULLS LAST) * {mixing.CIRCLE}.0::DOUBLE / greatest(1, sum(goal) OVER ()))::BIGINT AS hi FROM g),
k AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM c),
u AS (SELECT slot, ((slot % {mixing.CIRCLE}) * {mixing.STEP}) % {mixing.CIRCLE} AS u
      FROM (SELECT unnest(range((SELECT sum(need)::BIGINT FROM k))) AS slot)),
drawn AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
          FROM u JOIN k ON u.u >= k.lo AND u.u < k.hi AND need > 0),
had AS (SELECT source, count(*) AS had FROM drawn GROUP BY source),
slots AS (SELECT source, rank, slot FROM drawn
          UNION ALL SELECT source, rank, (SELECT sum(need)::BIGINT FROM k) + rank FROM (
            SELECT k.source, unnest(range(coalesce(had, 0), need)) AS rank FROM k LEFT JOIN had ON k.source IS NOT DISTINCT FROM had.source)),
rounds AS (SELECT rid, source, e * source_size + pos AS a, least(e * source_size + pos + size, goal) AS z
           FROM p, (SELECT unnest(range({mixing.EPOCHS})) AS e) WHERE size > 0),
pieces AS (SELECT rid, source, unnest(range(a // {mixing.BLOCK}, (z - 1) // {mixing.BLOCK} + 1)) AS rank FROM rounds WHERE a < z),
first AS (SELECT rid, min(slot) AS first_slot FROM pieces JOIN slots
          ON pieces.source IS NOT DISTINCT FROM slots.source AND pieces.rank = slots.rank GROUP BY rid)
SELECT doc_id, size, source_size, target, first_slot,
  (greatest(0, least(pos + size, goal) - pos) + greatest(0, least(source_size + pos + size, goal) - source_size - pos))::BIGINT AS taken
FROM p LEFT JOIN first USING (rid)"""


# ---------------------------------------------------------------- 8 token counts

TOKEN_LIMIT = 1024


def op8_fst_count(spark: SparkSession, sf: str) -> DataFrame:
    counts = fst_count.count_tokens(table(spark, sf, "documents"), tokenizer_file(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


# ---------------------------------------------------------------- 9 archives


def op9_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    warcs = arc.convert(arc.write_arc(table(spark, sf, "pages")))
    return arc.read_records(spark, warcs, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(text: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    out = [f"substr({letters}, ((concat('0x', substr(sha1({text}), {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)]
    return f"concat({', '.join(out)})"


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_base32_sql('p.html')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)"""


# ---------------------------------------------------------------- 10 URL rules

HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKED_WORDS = ("casino", "porn", "viagra", "xxx")


def url_rule_list() -> list[url_rules.UrlRule]:
    return [url_rules.host_rule(*r) for r in HOST_RULES] + [url_rules.word_rule("block", w) for w in BLOCKED_WORDS]


def op10_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, url_rules.rule_table(spark, url_rule_list()))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    ranked = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in ranked)
    words = "|".join(BLOCKED_WORDS)
    behind = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""
WITH b AS (SELECT page_id, coalesce({behind}, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
r AS (SELECT *, CASE {rule} END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE {verdict} WHEN regexp_matches(concat(host, path), '(?i)(^|[^0-9A-Za-z])({words})([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


# ---------------------------------------------------------------- 11 periodic runs


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.made_periodic(table(spark, sf, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", periodic_runs.strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    byte = f"list_transform(generate_series(1, length({text})), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), generate_series(1, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: {bits}), 4294967295)"


#: Matches of five words in a row at a lag, stretches of such places, the smallest lag per stretch.
OP11_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(generate_series(0, n - 1), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE ws END AS ws FROM p),
w AS (SELECT rid, n, unnest(generate_series(4, n - 1)) AS i, ws FROM d WHERE n >= 6),
f AS (SELECT rid, n, i, hash(ws[i - 3 : i + 1]) AS five FROM w),
m AS (SELECT x.rid, x.i, x.i - y.i AS q FROM f x JOIN f y ON x.rid = y.rid AND x.five = y.five AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
s AS (SELECT rid, q, min(i) - 4 AS first, count(*) + 4 AS m
      FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS stretch FROM m) GROUP BY rid, q, stretch),
r AS (SELECT rid, first - q AS start, m + q AS length, min(q) AS period FROM s WHERE m + q >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
b AS (SELECT rid, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
        first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best,
        list(struct_pack(f := start + period, t := start + length)) AS gone FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: len(list_filter(gone, lambda z: i - 1 >= z.f AND i - 1 < z.t)) = 0) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid)"""


# ---------------------------------------------------------------- 12 collocations


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents").select("lang", "text"))


def _op12_sql() -> str:
    c = collocations
    cut = lambda k, n: f"SELECT lang, p, n, f, {k} AS k, array_to_string(string_split(p, ' ')[:{k}], ' ') AS x, array_to_string(string_split(p, ' ')[{k + 1}:], ' ') AS y FROM f WHERE n = {n}"
    cuts = " UNION ALL ".join(cut(k, n) for n in range(2, c.LONGEST + 1) for k in range(1, n))
    inner = " UNION ALL ".join(
        f"SELECT lang, array_to_string(string_split(p, ' ')[{i + 1}:{i + n}], ' ') AS p, f FROM f WHERE n = {m}"
        for m in range(3, c.LONGEST + 1) for n in range(2, m) for i in range(m - n + 1)
    )
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k AS n, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS p
      FROM w, (SELECT unnest(generate_series(1, {c.LONGEST})) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, p, any_value(n) AS n, count(*)::BIGINT AS f FROM g GROUP BY lang, p HAVING count(*) >= {c.THRESHOLD}),
c AS ({cuts}),
v AS (SELECT c.lang, c.p, c.f AS a, c.k, x.f AS l, y.f AS r, ({2 * c.SCALE}::HUGEINT * c.f) // (x.f + y.f) AS score
      FROM c JOIN f x ON c.lang = x.lang AND c.x = x.p JOIN f y ON c.lang = y.lang AND c.y = y.p),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, p, max(f) AS longer FROM ({inner}) GROUP BY lang, p),
k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, p) WHERE longer IS NULL OR 100::HUGEINT * longer < {c.SHARE}::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM k)
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= {c.TOP}"""


# ---------------------------------------------------------------- 13 exact top-k

QUERY_EVERY = 20
SCALE = 64


def op13_voronoi_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", voronoi_join.whole(F.col("embedding"), SCALE).alias("vec"))
    return voronoi_join.top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


OP13_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
      FROM v q JOIN v x ON q.vec_id % {QUERY_EVERY} = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {voronoi_join.K}"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op4_simhash_trie": op4_simhash_trie,
    "op3_packing": op3_packing,
    "op5_imatch": op5_imatch,
    "op8_fst_count": op8_fst_count,
    "op6_token_frames": op6_token_frames,
    "op7_mixing": op7_mixing,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_voronoi_topk": op13_voronoi_topk,
}

SQL = {"op1_quality_rules": _op1_sql(), "op7_mixing": OP7_SQL, "op9_arc_to_warc": OP9_SQL, "op10_url_rules": _op10_sql(), "op11_periodic_runs": OP11_SQL, "op12_collocations": _op12_sql(), "op13_voronoi_topk": OP13_SQL}
