"""The ten operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import exact_dedup, language, license_scan, line_dedup, mixing, near_dedup, pieces, quality, secret_scan, token_counts


def vocabulary(name: str) -> str:
    """A tokenizer file's place; a deployment passes its own path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "top_score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact_dedup.exact_dedup(docs, {"text_sha256": F.sha2(F.coalesce(docs["text"], F.lit("")), 256)})


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), "digests")
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), width=3, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_secret_scan, op2_exact_dedup, op3_sentencepiece, op4_license_scan, op5_quality_rules, op6_token_counts, op7_near_dedup, op8_mixing, op9_language_id, op10_line_dedup, pipeline]
    return {f.__name__: f for f in found}


_W = "string_split_regex(trim(regexp_replace({}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ')"


def _words(text: str) -> str:
    w = _W.format(text)
    return f"list_filter({w}, lambda x: x <> '')"


def _license_sql() -> str:
    """Every line, paragraph and window against every template; windows only where the whole text shares enough of a template's bigrams."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(n, t, False) for n, t in license_scan.TEMPLATES] + [(n, t, True) for n, t in license_scan.TEXTS]
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(' '.join(license_scan.template_words(t)))}, {whole})" for i, (n, t, whole) in enumerate(known))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    least = license_scan.LEAST_DICE
    dice = "2.0::DOUBLE * len(list_intersect(sg, tg)) / (len(sg) + len(tg))"
    norm = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
    return f"""
    WITH t AS (SELECT i AS tid, license, whole, len(w) - 1 AS k, list_distinct({pairs}) AS tg FROM (SELECT i, license, whole, string_split(txt, ' ') AS w FROM (VALUES {rows}) v(i, license, txt, whole))),
    base AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
    seg AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS s FROM base
            UNION ALL SELECT doc_id, unnest(list_filter(string_split_regex(txt, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n'), lambda p: contains(p, chr(10)))) FROM base),
    g AS (SELECT doc_id, list_distinct({pairs}) AS sg FROM (SELECT doc_id, {norm.format("s")} AS w FROM seg) WHERE len(w) > 1),
    whole AS (SELECT doc_id, {pairs} AS wg FROM (SELECT doc_id, {norm.format("txt")} AS w FROM base) WHERE len(w) > 1),
    near AS (SELECT doc_id, license, wg, tg, k FROM whole, t WHERE len(list_intersect(wg, tg)) * (2 - {least}) >= {least} * len(tg) - 1e-9),
    win AS (SELECT doc_id, license, tg, list_distinct(list_slice(wg, i, i + k - 1)) AS sg FROM (SELECT *, unnest(range(1, greatest(len(wg) - k + 1, 1) + 1)) AS i FROM near)),
    d AS (SELECT doc_id, license, max(dice) AS dice FROM (
        SELECT doc_id, license, {dice} AS dice FROM g, t WHERE NOT whole AND len(sg) < 100 UNION ALL SELECT doc_id, license, {dice} FROM win) GROUP BY ALL),
    hit AS (SELECT * FROM d WHERE dice >= {least}),
    best AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM hit GROUP BY doc_id),
    name AS (SELECT hit.doc_id, min(license) AS license FROM hit JOIN best USING (doc_id) WHERE hit.dice = best.dice GROUP BY 1)
    SELECT b.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, name.license AS license, coalesce(dice, 0.0::DOUBLE) AS dice
    FROM base b LEFT JOIN best USING (doc_id) LEFT JOIN name USING (doc_id)"""


_QUALITY = f"""
    WITH base AS (SELECT doc_id, source, coalesce(text, '') AS txt FROM documents),
    w AS (SELECT doc_id, source, txt, {_words('txt')} AS ws FROM base),
    pos AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM pos) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
    raw AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line FROM base),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    ln AS (SELECT doc_id, source, txt, lower(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')) AS line FROM (SELECT doc_id, source, txt, unnest(string_split(txt, chr(10))) AS line FROM base)),
    freq AS (SELECT source, line, count(DISTINCT txt) AS docs FROM ln WHERE line <> '' GROUP BY ALL),
    hosts AS (SELECT source, count(DISTINCT txt) AS docs FROM base GROUP BY 1),
    common AS (SELECT f.source, f.line FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.docs > greatest({quality.LEAST_DOCS}, h.docs * {quality.SHARE}::DOUBLE)),
    gone AS (SELECT l.doc_id, sum(len({_words('l.line')})) AS n FROM ln l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY 1),
    s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            len(regexp_extract_all(txt, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
            coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed
          FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND NOT (n_removed > 0 AND (n_words - n_removed < 50 OR n_words - n_removed < {quality.LEAST_LEFT} * n_words)) AS kept
    FROM s"""

_NEAR = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id"""

_MIXING = f"""
    WITH s AS (SELECT doc_id, source, len({_words("coalesce(text, '')")})::BIGINT AS size FROM documents),
    p AS (SELECT source, sum(size)::BIGINT AS ss, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s GROUP BY source),
    c AS (SELECT *, ss * 2.0::DOUBLE AS cap, (sum(ss) OVER ()) * 1.5::DOUBLE AS total FROM p),
    f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
          FROM c WINDOW o AS (ORDER BY cap / w, w, source NULLS LAST)),
    l AS (SELECT *, max(CASE WHEN (total - done) / rest * w <= cap THEN (total - done) / rest END) OVER () AS lv FROM f),
    t AS (SELECT source, ss, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * w) END AS target FROM l),
    r AS (SELECT s.doc_id, size, ss, target, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS rate,
            ('0x' || substr(md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
          FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, ss AS source_size, target, (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken FROM r"""

_LINES = """
    WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i, ls[i] AS raw, regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM base)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE t <> ''),
    win AS (SELECT a.doc_id, a.i, b.i AS i2, c.i AS i3, a.t || chr(10) || b.t || chr(10) || c.t AS h
            FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.r = a.r + 1 JOIN k c ON a.doc_id = c.doc_id AND c.r = a.r + 2),
    late AS (SELECT * FROM (SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS d1, first_value(i3) OVER o AS e1 FROM win WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, d1, e1, unnest([i, i2, i3]) AS i FROM late) WHERE doc_id <> d1 OR i > e1),
    kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS txt
             FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
    SELECT doc_id, n_lines, n_removed, sha256(txt) AS text_sha256 FROM kept"""

_EXACT = """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _EXACT, "op4_license_scan": _license_sql(), "op5_quality_rules": _QUALITY, "op7_near_dedup": _NEAR, "op8_mixing": _MIXING, "op10_line_dedup": _LINES}
