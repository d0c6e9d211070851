"""Registered queries of the pipeline operators and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import decontaminate, fixity, importance, language, licences, mixing, nearduplicates, passages, pseudolikelihood, repetition, spelling, tokens, urls
from cohortlens.llm.shared import new_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


MIXED_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
    FROM sizes GROUP BY source
), capped AS (
    SELECT *, CAST(k % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap FROM totals
), levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT)
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS level
    FROM capped WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, least(coalesce((SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1), 0) * weight,
        CAST(cap AS DOUBLE)) AS target FROM levels
), units AS (
    SELECT source, doc_id, CAST(sum(size) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM sizes GROUP BY source, doc_id HAVING sum(size) > 0
), slices AS (
    SELECT *, (('0x' || substr(key, 1, 8))::BIGINT) % 4096 AS slice FROM units
), sent AS (
    SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY slice, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sent FROM slices
), items AS (
    SELECT s.*, e.epoch, (e.epoch * t.source_size + s.sent) / t.target AS finish
    FROM sent s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e WHERE t.target > 0
), served AS (
    SELECT *, CAST(sum(size) OVER (ORDER BY finish, key, source ASC NULLS LAST, doc_id NULLS FIRST, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM items
), taken AS (
    SELECT source, doc_id, count(*) AS copies, min(upto - size) AS first_served FROM served
    WHERE upto <= (SELECT sum(source_size) FROM targets) GROUP BY source, doc_id
)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(n.copies, 0) * s.size AS BIGINT) AS taken, CAST(n.first_served AS BIGINT) AS first_served
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken n ON s.source IS NOT DISTINCT FROM n.source AND s.doc_id IS NOT DISTINCT FROM n.doc_id
"""


@query()
def op1_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(MIXED_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


TOKENIZER = "word_bpe_49k.json"


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return tokens.document_checksums(spark, path)


@query()
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def damaged(store: DataFrame) -> DataFrame:
    """A replica with damage that the record id decides: bytes changed, records lost, records under another name."""
    mark = F.substring(F.md5(F.col("record_id").cast("string")), 1, 2)
    torn = F.concat(F.col("record").substr(F.lit(1), F.length("record") - 5), F.lit("?\r\n\r\n"))
    renamed = F.regexp_replace("record", "^WARC/1.1", "WARC/1.0")
    return store.where(~F.coalesce(mark == "01", F.lit(False))).withColumn("record", F.when(mark == "00", torn).when(mark == "02", renamed).otherwise(F.col("record")))


FIXITY_SQL = r"""
WITH records AS (
    SELECT page_id, md5(CAST(page_id AS VARCHAR))[1:2] AS mark, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ',
        coalesce(url, '-'), chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), '-'), '>', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
        'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
    FROM pages
)
SELECT page_id AS record_id, CASE WHEN mark = '01' THEN 'missing' ELSE 'changed' END AS kind, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
    CASE mark WHEN '00' THEN sha256(concat(substr(record, 1, length(record) - 5), '?', chr(13), chr(10), chr(13), chr(10)))
        WHEN '02' THEN sha256('WARC/1.0' || substr(record, 9)) END AS found_digest
FROM records WHERE mark IN ('00', '01', '02')
"""


@query(FIXITY_SQL)
def op5_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = fixity.store(table(spark, sf_dir, "pages"))
    replica = written(damaged(original), "replica")
    return fixity.audit(original, replica).select("record_id", "kind", "length", "digest", "found_digest")


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query()
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolikelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _normalised(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), {_text(licences.INTRODUCTION)}, 'under ')"


def _rules_applied(x: str) -> str:
    for k, (_, _, parts) in enumerate(licences.RULES):
        pattern = f" {f'  (?:-  ){{0,{licences.GAP}}}'.join(parts)} "
        x = f"regexp_replace({x}, {_text(pattern)}, ' @{k} ', 'g')"
    return x


_SENTENCES = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in licences.SENTENCES.items())
_RULES = ", ".join(f"({k}, {_text(name)}, {_text(kind)})" for k, (name, kind, _) in enumerate(licences.RULES))
_LINES = "CASE WHEN k.id IS NULL AND contains(s, chr(10)) AND NOT coalesce(copyright, false) THEN string_split(s, chr(10)) ELSE [s] END"
LICENCE_SQL = f"""
WITH known(sentence, id) AS (VALUES {_SENTENCES}), rule(k, licence, kind) AS (VALUES {_RULES}),
docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
cut AS (SELECT r, list_filter(string_split(regexp_replace(text, {_text(licences.SENTENCE_END)}, chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS s
    FROM docs),
seg AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM cut),
norm AS (SELECT *, {_normalised('s')} AS n, regexp_matches({_normalised('s')}, {_text(licences.COPYRIGHT)}) AS copyright FROM seg),
lists AS (SELECT r, i, {_LINES} AS lines FROM norm LEFT JOIN known k ON k.sentence = n),
lines AS (SELECT r, i, unnest(lines) AS l, generate_subscripts(lines, 1) AS j FROM lists),
ids AS (SELECT r, i, j, coalesce(k.id, CASE WHEN regexp_matches({_normalised('l')}, {_text(licences.COPYRIGHT)}) THEN 'COPYRIGHT' END, '-') AS id
    FROM lines LEFT JOIN known k ON k.sentence = {_normalised('l')}),
seqs AS (SELECT r, list(id ORDER BY i, j) AS ids FROM ids GROUP BY r),
taken AS (SELECT r, ids, regexp_extract_all({_rules_applied("' ' || array_to_string(ids, '  ') || ' '")}, '@([0-9]+)', 1) AS rules FROM seqs),
named AS (SELECT r, licence, kind, min(pos) AS pos FROM (SELECT r, unnest(rules) AS k, generate_subscripts(rules, 1) AS pos FROM taken) t
    JOIN rule ON rule.k = CAST(t.k AS INTEGER) GROUP BY r, licence, kind),
verdict AS (SELECT r, string_agg(licence, ',' ORDER BY pos) AS licences, min(CASE kind WHEN 'restricted' THEN 1 WHEN 'copyleft' THEN 2 ELSE 3 END) AS strict FROM named GROUP BY r)
SELECT doc_id, CAST(coalesce(len(list_filter(ids, lambda x: x <> '-')), 0) AS BIGINT) AS n_known, coalesce(licences, '') AS licences,
    CASE WHEN strict = 1 THEN 'restricted' WHEN strict = 2 THEN 'copyleft' WHEN strict = 3 THEN 'permissive'
        WHEN len(list_filter(ids, lambda x: x NOT IN ('-', 'COPYRIGHT'))) > 0 THEN 'unclear' ELSE 'none' END AS category
FROM docs LEFT JOIN taken USING (r) LEFT JOIN verdict USING (r)
"""


@query(LICENCE_SQL)
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query()
def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept longest_repeat n_repeats covered_share"
    return out.select(*names.split())


_CRC_TABLE = "SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)"


def _crc(x: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a non-empty string, with the table ``t`` in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = f"unnest(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w"
IMPORTANCE_SQL = f"""
WITH tbl AS ({_CRC_TABLE}), docs AS (SELECT *, row_number() OVER () AS r FROM documents),
own AS (SELECT r, w, count(*) AS c FROM (SELECT r, {_FEATURES} FROM docs) GROUP BY r, w),
wanted AS (SELECT w, count(*) AS c FROM (SELECT {_FEATURES} FROM benchmark) GROUP BY w),
code AS (SELECT w, {_crc('w')} % 10000 AS b FROM (SELECT w FROM own UNION SELECT w FROM wanted), tbl),
s AS (SELECT b, sum(c) AS s FROM own JOIN code USING (w) GROUP BY b), t AS (SELECT b, sum(c) AS t FROM wanted JOIN code USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000)
    / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
mean AS (SELECT r, CAST(sum(c) AS BIGINT) AS n, CAST(floor(sum(c * gain) / sum(c)) AS BIGINT) AS weight FROM own JOIN code USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM docs LEFT JOIN mean USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS place,
    sum(CAST(n_features >= 20 AS BIGINT)) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


@query(IMPORTANCE_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = importance.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return importance.ranked(scores).select("row.doc_id", "n_features", "weight", "score", "rank")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _host(x: str) -> str:
    return _LOWER.format(f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://([^/?#]*)', 1)")


def _path(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _url_key(x: str) -> str:
    asked = f"array_to_string(list_filter(string_split(regexp_extract({x}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^({'|'.join(urls.TRACKING)})(=|$)')), '&')"
    path = f"CASE WHEN {_path(x)} = '' THEN '/' ELSE {_path(x)} END"
    return f"CASE WHEN contains({x}, '://') THEN regexp_replace({_host(x)}, ':(80|443)$', '') || {path} || CASE WHEN {asked} = '' THEN '' ELSE '?' || {asked} END END"


def _attribute(name: str) -> str:
    found = f"""regexp_extract(tag, '(?is)\\b{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))')"""
    return f"""regexp_replace(trim(regexp_replace({found}, '(?s)^[^=]*=\\s*', '')), '^["'']|["'']$', '', 'g')"""


_JUDGED = """SELECT {own}, arg_max(rule, key) AS rule, arg_max(verdict, key) AS verdict FROM (
    SELECT {own}, r.host || r.path AS rule, r.verdict, (length(r.host || r.path), r.verdict = 'allow', length(r.host)) AS key FROM {rows} x
    JOIN rule r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)) GROUP BY {own}"""
_ROOT, _FULL_ROOT = ("regexp_extract({}, '(?s)^(.*?://[^/?#]*)', 1)".format(x) for x in ("base", "link_url"))
URL_SQL = f"""
WITH RECURSIVE rule(verdict, host, path) AS (VALUES {', '.join(f"({_text(v)}, {_text(r.split('/', 1)[0])}, {_text('/' + r.split('/', 1)[1])})" for v, r in URL_RULES)}),
page AS (SELECT row_number() OVER () AS i, page_id, url, html, {_host('url')} AS host, {_path('url')} AS path FROM pages),
tag AS (SELECT url AS base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM page),
attribute AS (SELECT base, lower({_attribute('rel')}) AS rel, lower({_attribute('http-equiv')}) AS equiv, lower({_attribute('property')}) AS prop,
    {_attribute('href')} AS href, {_attribute('content')} AS content FROM tag WHERE regexp_matches(tag, '(?i)canonical|refresh|og:url')),
link AS (SELECT base, trim(replace(CASE WHEN regexp_matches(rel, '(^|\\s)canonical(\\s|$)') THEN href
    WHEN equiv = 'refresh' THEN regexp_extract(content, '(?is)^\\s*[0-9.]*\\s*[;,]\\s*url\\s*=\\s*["'']?(.*?)["'']?\\s*$', 1) WHEN prop = 'og:url' THEN content END, '&amp;', '&')) AS l FROM attribute),
target AS (SELECT base, CASE WHEN regexp_matches(l, '(?i)^https?://') THEN l WHEN regexp_matches(l, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
    WHEN starts_with(l, '//') THEN regexp_extract(base, '(?s)^(.*?:)//', 1) || l WHEN starts_with(l, '/') THEN {_ROOT} || l
    WHEN starts_with(l, '?') THEN {_ROOT} || {_path('base')} || l WHEN l = '' OR starts_with(l, '#') THEN NULL
    ELSE {_ROOT} || CASE WHEN contains({_path('base')}, '/') THEN regexp_replace({_path('base')}, '[^/]*$', '') ELSE '/' END || l END AS link_url FROM link),
walked AS (SELECT base, CASE WHEN regexp_matches({_path('link_url')}, '/\\.\\.?(/|$)') THEN {_FULL_ROOT}
    || list_reduce(string_split({_path('link_url')}, '/'), lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END)
    || regexp_extract(link_url, '(?s)^.*?://[^?#]*([?#].*)?$', 1) ELSE link_url END AS target FROM target),
given AS (SELECT {_url_key('base')} AS a, {_url_key('target')} AS b FROM walked),
edge AS (SELECT a, b FROM given WHERE a <> b UNION SELECT b, a FROM given WHERE a <> b),
reach(id, other) AS (SELECT a, a FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
node AS (SELECT DISTINCT id, id[1:strpos(id, '/') - 1] AS host, regexp_extract(id[strpos(id, '/'):], '(?s)^([^?]*)', 1) AS path FROM reach),
decided AS (SELECT reach.id, min(verdict) AS decision FROM reach JOIN ({_JUDGED.format(own='id', rows='node')}) j ON reach.other = j.id GROUP BY reach.id)
SELECT page_id, host, path, rule, coalesce(verdict, decision, 'allow') AS verdict FROM page LEFT JOIN ({_JUDGED.format(own='i', rows='page')}) USING (i)
LEFT JOIN decided ON rule IS NULL AND decided.id = {_url_key('url')}
"""


@query(URL_SQL)
def op12_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge(pages.select("page_id", "url"), urls.rule_table(spark, URL_RULES), urls.page_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SPELLING_SQL = f"""
WITH RECURSIVE tbl AS ({_CRC_TABLE}),
run AS (SELECT d, {_LOWER.format('raw')} AS w, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents) GROUP BY ALL),
coded AS (SELECT w, c, {_crc("d || ':' || w")} AS h FROM run, tbl),
word AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM coded)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM word)),
near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN word w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN word w ON w.word = c.rest),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS other, max(n) AS other_n FROM near JOIN word w ON w.word = b GROUP BY a),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM word LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.root WHERE e.form IS NULL
"""


@query(SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
