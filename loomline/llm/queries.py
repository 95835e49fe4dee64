"""Queries over the synthetic tables, one per operator, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, collocations, exact_dedup, licenses, merkle, mixing, partenum, pii, quality, repeats, token_count, topk, warc
from loomline.llm.common import scratch_path, vocabulary

THRESHOLD = 0.3
KEY = b"surrogates of the synthetic tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, packed=True, offsets="at").select("doc_id", "ids", "at")
    back = bpe.decode(ids, path, offsets="at")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(key: str = "doc_id") -> object:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str]) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return quality.score(docs.select(*keep), quality.train(docs, labels))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark, documents(spark, sf_dir), sf_dir, ["doc_id", "text"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.surrogates(documents(spark, sf_dir).select("doc_id", "text"), KEY)
    return replaced.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.col("entities.type"))), ",").alias("types"), "text")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.components(documents(spark, sf_dir), k=3, num=90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = vectors.select(F.col("vec_id").alias("_id"), topk.quantise(F.col("embedding")).alias("_v"))
    return topk.top_k(vectors, vectors.where("_id % 20 = 0"), 20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path, payload=False).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.substring_index(c, ":", -1).cast("long")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir).select("text", "lang"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = {"n_chars": F.when(hit, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}
    return merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], more)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    told = {"n_removed": lost, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
    return repeats.repeats(documents(spark, sf_dir), columns=told)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_surrogates": op3_surrogates, "op4_mix": op4_mix, "op5_ngram_join": op5_ngram_join, "op6_token_counts": op6_token_counts,
    "op7_top_k": op7_top_k, "op8_warc": op8_warc, "op9_exact_dedup": op9_exact_dedup, "op10_licenses": op10_licenses,
    "op11_collocations": op11_collocations, "op12_merkle": op12_merkle, "op13_repeats": op13_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
  (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER past, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER past, 0.0)) AS level
  FROM w WINDOW past AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, ratio) FROM l WHERE level <= ratio), ratio) * weight) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j""",
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 90 * (a.n + b.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 8) * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM t""",
    "op10_licenses": r"""
WITH t(label, base, notice, phrase) AS (VALUES
  ('cc-by', true, 'cc by', 'cc by'),
  ('gpl', true, 'general public license', 'general public license'),
  ('reserved', true, 'all rights reserved', 'all rights reserved'),
  ('apache-2.0', false, 'licensed under the apache license version 2 0', 'apache license version 2 0'),
  ('bsd-3-clause', false, 'redistribution and use in source and binary forms with or without modification are permitted', 'redistribution and use in source and binary forms'),
  ('cc-by-4.0', false, 'licensed under cc by 4 0', 'cc by 4 0'),
  ('cc-by-nc-4.0', false, 'licensed under cc by nc 4 0', 'cc by nc 4 0'),
  ('cc-by-sa-4.0', false, 'licensed under cc by sa 4 0', 'cc by sa 4 0'),
  ('gpl-2.0', false, 'licensed under the gnu general public license version 2', 'gnu general public license version 2'),
  ('gpl-3.0', false, 'licensed under the gnu general public license version 3', 'gnu general public license version 3'),
  ('isc', false, 'permission to use copy modify and or distribute this software for any purpose', 'copy modify and or distribute this software'),
  ('lgpl-2.1', false, 'licensed under the gnu lesser general public license version 2 1', 'gnu lesser general public license version 2 1'),
  ('mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software', 'permission is hereby granted free of charge'),
  ('mit', false, 'released under the mit license', 'mit license'),
  ('mpl-2.0', false, 'subject to the terms of the mozilla public license v 2 0', 'mozilla public license'),
  ('agpl-3.0', false, 'licensed under the gnu affero general public license version 3', 'gnu affero general public license'),
  ('artistic-2.0', false, 'released under the artistic license 2 0', 'artistic license 2 0'),
  ('bsl-1.0', false, 'distributed under the boost software license version 1 0', 'boost software license'),
  ('cc0-1.0', false, 'released under the creative commons zero v1 0 universal license', 'creative commons zero'),
  ('epl-2.0', false, 'made available under the terms of the eclipse public license 2 0', 'eclipse public license'),
  ('wtfpl', false, 'do what the fuck you want to public license', 'do what the fuck you want to'),
  ('zlib', false, 'this software is provided as is without any express or implied warranty in no event will the authors be held liable', 'in no event will the authors be held liable'),
  ('unlicense', false, 'this is free and unencumbered software released into the public domain', 'free and unencumbered software')),
k AS (SELECT *, string_split(notice, ' ') AS nw, string_split(phrase, ' ') AS pw, len(string_split(split_part(' ' || notice || ' ', ' ' || phrase || ' ', 1), ' ')) - 1 AS off FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT d.doc_id, d.w, k.*, unnest(list_filter(range(1, len(w) - len(pw) + 2), lambda i: w[i] = pw[1] AND w[i:i + len(pw) - 1] = pw)) AS place FROM d CROSS JOIN k),
h AS (SELECT *, list_sum(list_transform(range(1, len(nw) + 1), lambda i: CASE WHEN place - off - 1 + i BETWEEN 1 AND len(w) AND w[place - off - 1 + i] = nw[i] THEN 1 ELSE 0 END)) / len(nw)::DOUBLE AS share FROM m),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place - 1) FILTER (base) AS first_word, max(place - 1) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (base), []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, CASE WHEN count(*) FILTER (base) > 0 THEN 1.0::DOUBLE ELSE max(share) END AS score FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS term FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM c q JOIN c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
o AS (SELECT DISTINCT a.lang, a.phrase FROM c a JOIN c b ON a.lang = b.lang AND b.k > a.k AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') AND 100::HUGEINT * b.f >= 80::HUGEINT * a.f),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM c ANTI JOIN o USING (lang, phrase)),
u AS (SELECT s.lang, s.phrase, s.f AS a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * s.f) // (l.f + r.f))::BIGINT AS score FROM s JOIN (VALUES (1), (2), (3)) x(k) ON x.k < s.k
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:x.k], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[x.k + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_merkle": """
WITH RECURSIVE b AS (SELECT doc_id, lang, CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS more,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
d AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen((n_chars + coalesce(more, 0))::VARCHAR) || ':' || (n_chars + coalesce(more, 0)), '-') || tail) AS other FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS nth FROM d),
v AS (SELECT lang, 0 AS k, list(leaf ORDER BY nth) AS nodes FROM r GROUP BY lang UNION ALL
  SELECT lang, k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM v WHERE len(nodes) > 1),
g AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth FROM v WHERE len(nodes) = 1),
u AS (SELECT 0 AS k, list(subroot ORDER BY nth) AS nodes FROM g UNION ALL
  SELECT k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1),
s AS (SELECT r.lang, r.nth, v.k, (r.nth >> v.k::BIGINT) AS i, v.nodes FROM r JOIN v ON r.lang IS NOT DISTINCT FROM v.lang WHERE len(v.nodes) > 1 UNION ALL
  SELECT r.lang, r.nth, 1000 + u.k, (g.nth >> u.k::BIGINT), u.nodes FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang CROSS JOIN u WHERE len(u.nodes) > 1),
p AS (SELECT lang, nth, list(CASE WHEN i % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(i, 1) + 1], '') ORDER BY k) AS way FROM s GROUP BY lang, nth),
f AS (SELECT r.doc_id, r.leaf, g.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(array_to_string(list_transform(coalesce(way, []), lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce([r.other] || coalesce(way, []), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.nth = r.nth)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f""",
    "op13_repeats": """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS own, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT row, own, unnest(range(0, len(h) // 2 - 49, 500)) AS q, h FROM d),
e AS (SELECT row, own, q, substr(h, 2 * q + 1, 1098) AS h FROM c),
w AS (SELECT row, own, q + unnest(range(0, least(500, len(h) // 2 - 49))) AS p, unnest(list_transform(range(0, least(500, len(h) // 2 - 49)), lambda i: substr(h, 2 * i + 1, 100))) AS x FROM e),
m AS (SELECT x, min(own) AS least FROM w GROUP BY x),
g AS (SELECT row, p, least < own AS gone FROM w JOIN m USING (x)),
i AS (SELECT row, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM g WHERE gone WINDOW o AS (PARTITION BY row ORDER BY p)),
r AS (SELECT row, p, sum(new) OVER (PARTITION BY row ORDER BY p) AS run FROM i),
s AS (SELECT row, min(p) AS first, max(p) + 50 AS past FROM r GROUP BY row, run),
k AS (SELECT row, first, past, coalesce(lag(past) OVER o, 0) AS before FROM s WINDOW o AS (PARTITION BY row ORDER BY first)),
t AS (SELECT row, sum(past - first)::BIGINT AS n_removed, count(*) AS n_spans, max(past) AS past, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS kept FROM k JOIN d USING (row) GROUP BY row)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (row)""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
