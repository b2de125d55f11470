"""The registered queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import licences, pii
from lakewright.llm.ann import nearest
from lakewright.llm.binary_ids import NO_KEY, documents_in, store_ids
from lakewright.llm.common import table
from lakewright.llm.exact_topk import top_k
from lakewright.llm.language import held_out, recognise
from lakewright.llm.merkle import fold, leaf, manifest, proof
from lakewright.llm.mixing import mix
from lakewright.llm.packing import pack
from lakewright.llm.pieces import encode_documents
from lakewright.llm.ranked import ranked_search
from lakewright.llm.repeats import remove_repeats
from lakewright.llm.simhash import near_duplicates
from lakewright.llm.tokens import vocabulary_path


def op1_binary_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    keys = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_KEY)).alias("key"))
    return documents_in(store_ids(docs), keys)


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", pii.report(F.col("text"), pii.train(docs)).alias("found"))
    return found.select("doc_id", "found.*")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicates(table(spark, folder, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = recognise(docs, ~held_out(F.col("doc_id")), "found", ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.accepted", "found.entropy")


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.scan(docs, licences.train(docs))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents")).drop("loss")


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    texts = encode_documents(table(spark, folder, "documents"), vocabulary_path("piece_bpe_32k.model"))
    tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return texts.select("doc_id", tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [F.col(c) for c in names]
    cut = [F.replace(c, F.lit("\n"), F.lit("")) if name == "text" else c for name, c in zip(names, values)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(cut)).otherwise(leaf(values))
    leaves = manifest(docs, values, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": tampered}).leaves
    folded = leaves.select("*", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


def op13_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_binary_ids": op1_binary_ids,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_licences": op5_licences,
    "op6_mixing": op6_mixing,
    "op7_ann": op7_ann,
    "op8_exact_topk": op8_exact_topk,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
    "op11_pieces": op11_pieces,
    "op12_merkle": op12_merkle,
    "op13_ranked": op13_ranked,
}
ORACLES: dict[str, str] = {
    "op8_exact_topk": """
        WITH clean AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM clean q JOIN clean c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    # DuckDB has no crc32, hence the list_reduce of bits; levels go up in a recursive table.
    "op12_merkle": """
        WITH RECURSIVE rows AS (
            SELECT row_number() OVER () AS r, * FROM documents
        ), fields AS (
            SELECT r, doc_id, coalesce('+' || source, '') AS g, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS d, text AS e,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda h, x: list_reduce(list_prepend(xor(h, x), range(8)),
                           lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 2 = 0 AS hit
            FROM rows
        ), texts AS (
            SELECT r, doc_id, g,
                   concat(coalesce(strlen(a) || ':' || a, '-'), coalesce(strlen(b) || ':' || b, '-'), coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(d) || ':' || d, '-')) AS head,
                   e, CASE WHEN hit THEN replace(e, chr(10), '') ELSE e END AS cut
            FROM fields
        ), leaves AS (
            SELECT r, doc_id, g, sha256(head || coalesce(strlen(e) || ':' || e, '-')) AS leaf,
                   sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS tampered
            FROM texts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
        ), tree AS (
            SELECT g, 0 AS lvl, pos, n, leaf AS digest FROM placed
            UNION ALL
            SELECT g, any_value(lvl) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // 3
        ), tops AS (
            SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
        ), forest AS (
            SELECT 0 AS lvl, pos, n, subroot AS digest FROM tops
            UNION ALL
            SELECT any_value(lvl) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY pos // 3
        ), nodes AS (
            SELECT g, lvl, pos, n, digest FROM tree WHERE n > 1
            UNION ALL
            SELECT t.g, f.lvl + 1000, f.pos, f.n, f.digest FROM forest f CROSS JOIN (SELECT DISTINCT g FROM tops) t WHERE f.n > 1
        ), own AS (
            SELECT p.r, s.g, s.lvl, s.pos FROM placed p JOIN tree s ON s.g = p.g AND s.n > 1 AND s.pos = p.pos // pow(3, s.lvl)::BIGINT
            UNION ALL
            SELECT p.r, p.g, f.lvl + 1000, f.pos FROM placed p JOIN tops t ON t.g = p.g JOIN forest f ON f.n > 1 AND f.pos = t.pos // pow(3, f.lvl)::BIGINT
        ), steps AS (
            SELECT o.r, o.lvl, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < o.pos), '') AS before,
                   coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '') AS after
            FROM own o JOIN nodes s ON s.g = o.g AND s.lvl = o.lvl AND s.pos // 3 = o.pos // 3 GROUP BY o.r, o.lvl, o.pos
        ), paths AS (
            SELECT r, list({'b': before, 'a': after} ORDER BY lvl) AS path FROM steps GROUP BY r
        ), folds AS (
            SELECT p.r, 0 AS i, p.tampered AS held, coalesce(path, []) AS path FROM placed p LEFT JOIN paths USING (r)
            UNION ALL
            SELECT r, i + 1, sha256(path[i + 1].b || held || path[i + 1].a), path FROM folds WHERE i < len(path)
        ), ends AS (
            SELECT r, held AS folded_root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda s: s.b || s.a)), 'string_agg', '')) AS proof_sha256 FROM folds WHERE i = len(path)
        ), root AS (
            SELECT digest AS root FROM forest WHERE n = 1
        )
        SELECT p.doc_id, p.leaf, t.subroot, root.root, e.proof_sha256, e.folded_root, e.folded_root = root.root AS verified
        FROM placed p JOIN ends e USING (r) JOIN tops t ON t.g = p.g CROSS JOIN root
    """,
    "op13_ranked": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL
        ), sized AS (
            SELECT *, len(t) AS n FROM docs WHERE len(t) > 0
        ), whole AS (
            SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized
        ), tf AS (
            SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM sized) GROUP BY r, term
        ), w AS (
            SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term
        ), items AS (
            SELECT i, item_id, term, count(*)::BIGINT AS q FROM (
                SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY i, item_id, term
        ), scored AS (
            SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
            FROM items JOIN tf USING (term) JOIN w USING (term) JOIN sized USING (r), whole GROUP BY i, item_id, r, doc_id
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
