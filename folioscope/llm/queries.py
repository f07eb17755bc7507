"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import languages, look_alikes, mixing, packing, pairs, repeated_lines
from folioscope.llm.shared import written
from folioscope.llm.tokens import token_count
from folioscope.llm.top_n import top_n_per_group
from folioscope.session import spread
from folioscope.sources.tables import table


#: Pages of one filing on which a line must stand to count as repeated.
PAGES = 6


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = repeated_lines.keyed_rows(spread(table(spark, sf_dir, "chunks")), "chunk_id", "doc_id", "page_num", "text")
    confirmed = written(repeated_lines.repeated_lines(keyed, PAGES), "confirmed-lines")
    return repeated_lines.found_lines(keyed, confirmed).withColumnRenamed("key_of_row", "chunk_id")


def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk row with its text without the lines that come back page after page."""
    chunks = spread(table(spark, sf_dir, "chunks"))
    keyed = repeated_lines.keyed_rows(chunks, "chunk_id", "doc_id", "page_num", "text")
    confirmed = written(repeated_lines.repeated_lines(keyed, PAGES), "confirmed-lines")
    return repeated_lines.without_lines(chunks.select("chunk_id", "doc_id", "page_num", "text"), confirmed, "doc_id", "text").drop("text")


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[DataFrame, str, str, str]]]:
    sources = [(spread(table(spark, sf_dir, "chunks")), "chunk_id", "text", "chunks.text"), (spread(table(spark, sf_dir, "grading_baseline_dense")), "grade_id", "generated_answer", "generated_answer")]
    keyed = [look_alikes.keyed_texts(*s) for s in sources]
    return written(keyed[0].unionByName(keyed[1]), "keyed-texts"), sources


def _classes(texts: DataFrame, sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    return look_alikes.classes(texts, [(df, text, field) for df, _, text, field in sources])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, sources = _texts(spark, sf_dir)
    return look_alikes.same_reading_pairs(texts, _classes(texts, sources))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the canonical member of its class."""
    texts, sources = _texts(spark, sf_dir)
    found = _classes(texts, sources)
    a, b = (look_alikes.canonical_texts(*s, found) for s in sources)
    return a.unionByName(b)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with the number of members of its class that have another text: the scalable form of the pairs."""
    texts, sources = _texts(spark, sf_dir)
    return look_alikes.members(texts, _classes(texts, sources)).groupBy("field_name", "key").agg(F.max("links").alias("links"))


def _top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(table(spark, sf_dir, "retrieved_chunks"), ["run_label", "qid"], ["doc_id", "page_num"], "score", 10)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_pages(spark, sf_dir).select("run_label", "qid", "doc_id", "page_num")


def p4_top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages with their score and rank."""
    return _top_pages(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = spread(table(spark, sf_dir, "grading_baseline_dense"))
    spoken, terminal, most = pairs.models(spread(table(spark, sf_dir, "documents")), graded)
    return pairs.defects(graded, table(spark, sf_dir, "answers"), spoken, terminal, copies=most)


def p5_plain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found of the answers that are null, blank or their question word for word."""
    graded = table(spark, sf_dir, "grading_baseline_dense")
    plain = graded.where(F.col("generated_answer").isNull() | ~F.col("generated_answer").rlike(r"\S") | (F.col("generated_answer") == F.col("question")))
    return p5_found(spark, sf_dir).join(plain.select("grade_id").distinct(), "grade_id", "left_semi")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    sized = documents.select(F.col("doc_id").alias("key"), "source", token_count(F.col("text")).alias("tokens"), F.unhex(F.md5("text")).alias("cluster"))
    return written(sized, "sized-documents")


def _containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    # a fixed table of three rows
    return sorted((r["container"], r["capacity_tokens"]) for r in table(spark, sf_dir, "container_sizes").collect())


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), _containers(spark, sf_dir))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumn("doc_id", F.col("key").cast("long")).drop("key")


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of container: items, and what must not be there: overfull bins, small items split, copies of a text together, tokens lost."""
    sized = _sized(spark, sf_dir)
    return packing.invariants(packing.pack(sized, _containers(spark, sf_dir)), sized)


#: Sources whose texts are kept apart from each other in ``p6_kept_apart``: letters of the regulator and what the company says of itself.
APART = (("regulator_mail", "earnings_calls"), ("regulator_mail", "proxy_letters"))


def p6_kept_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing with pairs of sources that must not share a container: of each kind its items, bins above capacity, and bins in which such a pair met."""
    sized = _sized(spark, sf_dir)
    packed = packing.pack(sized, _containers(spark, sf_dir), apart=APART).join(sized.select(F.col("key").cast("string").alias("key"), "source"), "key")
    has = lambda s: F.max(F.coalesce((F.col("source") == s).cast("int"), F.lit(0)))
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"), F.greatest(*[has(a) + has(b) for a, b in APART]).alias("of_a_pair"))
    each = bins.groupBy("container", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), F.count_if(F.col("of_a_pair") > 1).alias("met"))
    return each.join(packed.groupBy("container").agg(F.count_distinct("key").alias("items")), "container").select("container", "capacity", "items", "overfull", "met")


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mixing.Plan]:
    sized = _sized(spark, sf_dir)
    wanted = table(spark, sf_dir, "mix_targets")  # a fixed table of nine rows
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in wanted.collect()]
    # one row for each target
    used = sized.where("tokens > 0").join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi").groupBy("source")
    sizes = {r["source"]: (r["records"], r["tokens"]) for r in used.agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens")).collect()}
    plan = mixing.plan(sizes, sorted(targets))
    return mixing.mixture(sized, plan), plan


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select(F.col("key").cast("long").alias("doc_id"), "source", "tokens", "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


#: How far a source's tokens may be from its target, as a share of the mixture; of a source with fewer records than ``FEW`` nothing is said.
WITHIN, FEW = 0.005, 30


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: its records with text, whether its tokens are within ``WITHIN`` of what the target asks for (null for few records), and whether no record is used more often than allowed."""
    mixed, plan = _mixed(spark, sf_dir)
    s = mixing.shares(mixed, plan)
    missed = F.abs(F.col("used_tokens") - F.col("tokens") * F.col("expected_copies"))
    return s.select("source", "target_share", "records", F.when(F.col("records") >= FEW, missed <= WITHIN * plan.total).alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"))


def _line_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return languages.line_languages(spread(documents), languages.fit(languages.sample(documents)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled_lines(_line_languages(spark, sf_dir))


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.stretches(_line_languages(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(_line_languages(spark, sf_dir))


def p8_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document whose label names no language, the lines that came out with one: all that have words."""
    lines = _line_languages(spark, sf_dir).where("label_lang IS NULL")
    return languages.mislabelled_lines(lines).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length("lang") == 2).alias("named"))


def p8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document with words, the first and last line of its stretches, and whether neighbours differ in language."""
    runs = languages.stretches(_line_languages(spark, sf_dir))
    before = F.lag("lang").over(Window.partitionBy("doc_id").orderBy("from_line"))  # a document's stretches
    each = runs.select("*", (before.isNull() | (before != F.col("lang"))).alias("differs"))
    return each.groupBy("doc_id").agg(F.min("from_line").alias("first_line"), F.max("to_line").alias("last_line"), F.min("differs").alias("all_differ"))


QUERIES = {
    "p2_found": p2_found,
    "p2_clean_text": p2_clean_text,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_top_pages": p4_top_pages,
    "p5_found": p5_found,
    "p5_plain_cases": p5_plain_cases,
    "p6_containers": p6_containers,
    "p6_fill_report": p6_fill_report,
    "p6_invariants": p6_invariants,
    "p6_kept_apart": p6_kept_apart,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_stretches": p8_stretches,
    "p8_documents": p8_documents,
    "p8_unlabelled": p8_unlabelled,
    "p8_runs": p8_runs,
}

_TOP_PAGES = """
WITH page AS (
  SELECT run_label, qid, doc_id, page_num, max(score) AS top_score FROM retrieved_chunks
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_label, qid ORDER BY top_score DESC, doc_id, page_num) AS INTEGER) AS top_rank FROM page
)
"""
# Letters and the Latin letter of the same shape, written out for the SQL, which does not use the library's own table.
_LIKE = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳόΌΆΈΊΎ", "ABEZHIKMNOPTYXCJovcjóÓÁÉÍÝ"),
    ("АВЕЅІЈКМНОРСТУХѴҺԀԚԜӀ", "ABESIJKMHOPCTYXVHDQWI"),
    ("аеорсухѕіјѵһԁԛԝӏ", "aeopcyxsijvhdqwl"),
    ("ЁёЇїЀѐ", "ËëÏïÈè"),
    ("ՕՏԼՍօսհո", "OSLUouhn"),
    ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))),
]
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _read_as(column: str) -> str:
    """SQL of what a text reads as, by other means than the library's."""
    sql = column
    for joined, letters in _JOINED.items():
        sql = f"replace({sql}, '{joined}', '{letters}')"
    quoted = lambda t: t.replace("'", "''")
    sql = f"translate({sql}, '{quoted(''.join(a for a, _ in _LIKE))}', '{quoted(''.join(b for _, b in _LIKE))}')"
    sql = rf"regexp_replace({sql}, '[\p{{Cf}}\x{{34f}}\x{{180b}}-\x{{180d}}\x{{fe00}}-\x{{fe0f}}\x{{e0100}}-\x{{e01ef}}\x00-\x08\x0e-\x1f\x7f]', '', 'g')"
    return rf"nfc_normalize(regexp_replace({sql}, '\p{{Zs}}', ' ', 'g'))"


_FORM = _read_as("t")
_OFTEN = f"""
numbered AS (SELECT chunk_id, doc_id, page_num, text, row_number() OVER () AS row FROM chunks),
split AS (SELECT chunk_id, doc_id, page_num, row, i AS line_no, lines[i] AS t FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM numbered WHERE text IS NOT NULL))),
keyed AS (SELECT *, regexp_replace(trim(regexp_replace(lower({_FORM}), '\\s+', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM split),
often AS (SELECT doc_id, k FROM keyed WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT page_num) >= {PAGES})
"""
_CLEAN = f"""WITH {_OFTEN},
marked AS (SELECT k.row, k.line_no, k.t, o.k IS NOT NULL AS drop FROM keyed k LEFT JOIN often o USING (doc_id, k)),
clean AS (SELECT row, coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (WHERE NOT drop), '') AS clean_text, CAST(count(*) FILTER (WHERE drop) AS INTEGER) AS lines_removed FROM marked GROUP BY row)
SELECT n.chunk_id, n.doc_id, n.page_num, c.clean_text, coalesce(c.lines_removed, 0) AS lines_removed FROM numbered n LEFT JOIN clean c USING (row)
"""
_NO_LABEL = "lower(trim(coalesce(lang, ''))) IN ('', 'und', 'unknown')"
_WORDY = "SELECT doc_id, lang, i AS line_no, lines[i] AS t FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"
_SAME = f"""
WITH texts AS (SELECT DISTINCT 'chunks.text' AS field_name, chunk_id AS key, text AS t FROM chunks UNION SELECT DISTINCT 'generated_answer', grade_id, generated_answer FROM grading_baseline_dense),
forms AS (SELECT *, {_FORM} AS form FROM texts WHERE t IS NOT NULL)
SELECT DISTINCT a.field_name, a.key AS key_a, b.key AS key_b FROM forms a JOIN forms b ON a.field_name = b.field_name AND a.form = b.form AND a.key < b.key AND a.t <> b.t WHERE regexp_matches(a.form, '\\S')
"""
_ITEMS = "(SELECT count(*) FROM documents WHERE text IS NOT NULL AND text <> '') AS items"
ORACLE = {
    "p5_plain_cases": r"SELECT DISTINCT grade_id, CASE WHEN generated_answer = question THEN 'copies_question' ELSE 'empty' END AS defect FROM grading_baseline_dense WHERE generated_answer IS NULL OR NOT regexp_matches(generated_answer, '\S') OR generated_answer = question",
    "p6_invariants": f"SELECT container, capacity_tokens AS capacity, {_ITEMS}, 0 AS overfull, 0 AS split, 0 AS met, 0 AS lost FROM container_sizes",
    "p6_kept_apart": f"SELECT container, capacity_tokens AS capacity, {_ITEMS}, 0 AS overfull, 0 AS met FROM container_sizes",
    "p7_invariants": f"""SELECT source, target_share, records, CASE WHEN records >= {FEW} THEN true END AS share_met, true AS cap_kept
FROM (SELECT t.source, t.target_share, count(d.doc_id) AS records FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY ALL)""",
    "p2_found": f"WITH {_OFTEN} SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (doc_id, k)",
    "p2_clean_text": _CLEAN,
    "p8_unlabelled": rf"SELECT doc_id, count(*) AS lines, count(*) AS named FROM ({_WORDY}) WHERE {_NO_LABEL} AND regexp_matches(t, '\p{{L}}') GROUP BY doc_id",
    "p8_runs": rf"SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, true AS all_differ FROM ({_WORDY}) WHERE regexp_matches(t, '\p{{L}}') GROUP BY doc_id",
    "p3_found": _SAME,
    "p3_canonical": _SAME.split("SELECT DISTINCT a.")[0] + "SELECT DISTINCT field_name, key, min(t) OVER (PARTITION BY field_name, form) AS canonical FROM forms WHERE regexp_matches(form, '\\S')",
    "p3_links": _SAME.split("SELECT DISTINCT a.")[0] + """, seen AS (SELECT DISTINCT field_name, key, t, form FROM forms WHERE regexp_matches(form, '\\S'))
SELECT field_name, key, max(links) AS links FROM (SELECT field_name, key, count(*) OVER (PARTITION BY field_name, form) - count(*) OVER (PARTITION BY field_name, form, t) AS links FROM seen) GROUP BY field_name, key""",
    "p4_found": _TOP_PAGES + "SELECT run_label, qid, doc_id, page_num FROM ranked WHERE top_rank <= 10",
    "p4_top_pages": _TOP_PAGES + "SELECT run_label, qid, doc_id, page_num, top_score, top_rank FROM ranked WHERE top_rank <= 10",
}
