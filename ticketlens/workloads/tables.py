"""Support-operations tables derived from the given benchmark tables.

Companies are regions, tickets are events, process documents and drafts are made
from the documents, chats from the conversations. Every derivation covers the
whole table. Defects (unreadable cells, tampered evidence, blank answers, …) are
written into rows by rules on their ids, so that every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators import metrics as me
from ticketlens.session import staged_by
from ticketlens.sources.dimensions import factor_table
from ticketlens.sources.schemas import COMPANY
from ticketlens.sources.tickets import CORRUPT

CATEGORIES = ("view", "click", "signup", "purchase", "error")
FACTORS = (
    ("view", 1.00, 1.00),
    ("click", 0.95, 0.95),
    ("signup", 0.65, 0.65),
    ("purchase", 0.50, 0.50),
    ("error", 0.18, 0.18),
)
OUTSIDE = "parking permits"


# Documents of a bucket, at least; large inputs have as many buckets as there are shuffle partitions.
PER_BUCKET = 1000


class ByBatch(str):
    """A folder of tables whose documents are also laid out by their id, in ``parts`` buckets."""

    documents: DataFrame
    parts: int


def by_batch(spark: SparkSession, sf_dir: str) -> ByBatch:
    """The folder with its documents shuffled and written once by id, so that what is derived from them isn't moved for joins by batch."""
    documents = table(spark, sf_dir, "documents")
    folder = ByBatch(sf_dir)
    folder.parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // PER_BUCKET)))
    folder.documents = staged_by(documents.repartition(folder.parts, "doc_id"), "documents-by-batch", "doc_id", folder.parts)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents" and isinstance(sf_dir, ByBatch):
        return sf_dir.documents
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def factors(spark: SparkSession) -> DataFrame:
    return factor_table(spark, FACTORS)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("region_key"), F.lower("r_name").alias("company_id")
    )


def _with_company(spark: SparkSession, sf_dir: str, frame: DataFrame, number: Column) -> DataFrame:
    return frame.withColumn("region_key", (number % 5).cast("int")).join(
        regions(spark, sf_dir), "region_key"
    ).drop("region_key")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions(spark, sf_dir), F.col("n_regionkey") == F.col("region_key"))
        .select("c_custkey", "company_id", F.lower("c_mktsegment").alias("customer_tier"))
    )
    return table(spark, sf_dir, "events").join(customers, F.col("user_id") == F.col("c_custkey"))


def _ticket_id(number: Column) -> Column:
    return F.concat(F.lit("TKT-"), F.lpad(number.cast("string"), 8, "0"))


def _escalated() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int") >= 85


def _channel() -> Column:
    return _pick(("email", "phone", "web form", "chat"), F.col("user_id") % 4)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "company_id",
        _ticket_id(F.col("event_id")).alias("ticket_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("category"),
        F.col("props").alias("description"),
        F.col("value").alias("resolution_minutes"),
        _escalated().alias("escalated"),
        _channel().alias("channel"),
        "customer_tier",
    )


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets as text cells in several notations, some of them defective or unreadable.

    One company writes its channels as numbers.
    """
    n = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = _pick(("Z", "+02:00", ""), n % 3)
    yes = _pick(("yes", "TRUE", "1", "on", "t"), n % 5)
    no = _pick(("no", "FALSE", "0", "off", "f"), n % 5)
    return _events(spark, sf_dir).select(
        "company_id",
        F.when(n % 107 == 0, F.lit(None))
        .when(n % 103 == 50, _ticket_id(F.floor(n / 500)))
        .otherwise(_ticket_id(n))
        .alias("ticket_id"),
        F.when(n % 79 == 0, "yesterday").otherwise(F.concat(iso, zone)).alias("created_at"),
        F.when(n % 97 == 0, OUTSIDE).otherwise(F.col("event_type")).alias("category"),
        F.when(n % 83 == 0, "").when(n % 89 == 0, "NA").otherwise(F.col("props")).alias("description"),
        F.when(n % 101 == 0, "-5")
        .when(n % 109 == 0, "ten")
        .otherwise(F.col("value").cast("string"))
        .alias("resolution_minutes"),
        F.when(n % 113 == 0, "maybe").when(_escalated(), yes).otherwise(no).alias("escalated"),
        F.when(F.col("company_id") == "europe", (n % 4).cast("string"))
        .when(n % 127 == 0, F.lit(None))
        .otherwise(_channel())
        .alias("channel"),
        "customer_tier",
        F.when(n % 131 == 0, F.lit("cut off")).alias(CORRUPT),
    )


def ticket_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The raw tickets as one file a company, some in another column order or without a column, and broken files beside them.

    By region: 1 has its columns in another order, 2 lacks one, 3 has a further file that ends within a row, 4 one without a byte.
    """
    raw = raw_tickets(spark, sf_dir).join(regions(spark, sf_dir), "company_id").drop(CORRUPT).repartition("company_id")
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}
    columns = [c for c in raw.columns if c not in ("company_id", "region_key")]
    for at, names in (("region_key NOT IN (1, 2)", columns), ("region_key = 1", columns[::-1]), ("region_key = 2", [c for c in columns if c != "channel"])):
        raw.filter(at).select("company_id", *names).write.mode("append").partitionBy("company_id").options(**options).csv(folder)
    by_number = {r["region_key"]: r["company_id"] for r in regions(spark, sf_dir).collect()}
    cut = spark.createDataFrame([(",".join(columns) + "\nTKT-1,2025-01-01T00:00",)], "value string")
    cut.coalesce(1).write.mode("append").text(f"{folder}/company_id={by_number[3]}")
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/company_id={by_number[4]}/part-empty.csv")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).create(empty).close()


def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("company_id")


def raw_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company metadata; two optional fields are missing for some companies."""
    staff = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").alias("region_key"))
        .agg(F.count(F.lit(1)).alias("support_team_size"), F.min("n_name").alias("headquarters"))
    )
    period = (
        tickets(spark, sf_dir)
        .groupBy("company_id")
        .agg(
            F.to_date(F.min("created_at")).alias("reporting_period_start"),
            F.to_date(F.max("created_at")).alias("reporting_period_end"),
            F.count(F.lit(1)).alias("_tickets"),
        )
    )
    name = F.initcap("company_id")
    return (
        regions(spark, sf_dir)
        .join(period, "company_id")
        .join(staff, "region_key", "left")
        .select(
            F.col("company_id").alias("id"),
            F.concat(name, F.lit(" Support Services")).alias("name"),
            F.lit("Online services").alias("industry"),
            F.concat(F.lit("Support desk for "), name).alias("description"),
            "headquarters",
            F.coalesce("support_team_size", F.lit(0).cast("bigint")).alias("support_team_size"),
            F.lit("Monday-Friday, 08:00-18:00").alias("support_hours"),
            "reporting_period_start",
            "reporting_period_end",
            F.lit("Derived from benchmark tables.").alias("disclaimer"),
            F.when(F.col("region_key") != 3, F.col("_tickets")).alias("ticket_count"),
            F.when(F.col("region_key") % 2 == 1, F.lit("Benchmark")).alias("demo_status"),
        )
        .select(*COMPANY.fieldNames())
    )


def cube(spark: SparkSession, sf_dir: str, *dimensions: str) -> DataFrame:
    return me.ticket_cube(tickets(spark, sf_dir), dimensions)


# Everything that belongs to one audit has the key ``batch_id``: the id of its document,
# and of its conversation, where there is one.


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_company(spark, sf_dir, table(spark, sf_dir, "documents"), F.col("doc_id")).withColumnRenamed(
        "doc_id", "batch_id"
    )


def _part(entries: Column, every: Column, at: Column) -> Column:
    """Every ``every``-th entry of an array, from ``at`` on."""
    return F.filter(entries, lambda _, i: i % every == at)


def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown process document per document; the whole text is kept.

    Of every four lines the first opens a section and gives its steps, the second
    its systems, the third its exceptions; the fourth stays plain. Some texts name
    another company, some quote a ticket, some hold column names, some are blank.
    """
    doc = F.col("batch_id")
    names = F.array(*(F.lit(c.capitalize()) for c in CATEGORIES))

    def marked(line: Column, i: Column) -> Column:
        heading = F.element_at(names, ((doc + F.floor(i / 4)) % 5 + 1).cast("int"))
        return (
            F.when(i % 4 == 0, F.concat(F.lit("## "), heading, F.lit("\n\n- **Manual steps:** "), line))
            .when(i % 4 == 1, F.concat(F.lit("- **Systems used:** "), line))
            .when(i % 4 == 2, F.concat(F.lit("- **Common exceptions:** "), line))
            .otherwise(line)
        )

    body = F.array_join(F.transform(F.split("text", "\n"), marked), "\n")
    neighbours = regions(spark, sf_dir).select(
        ((F.col("region_key") + 4) % 5).alias("_home"), F.col("company_id").alias("_neighbour")
    )
    quoted = table(spark, sf_dir, "events").filter("event_id % 61 = 5").select("event_id", F.col("props").alias("_quoted"))
    added = F.concat(
        F.when(doc % 17 == 0, F.concat(F.lit("\nShared desk with "), "_neighbour")).otherwise(""),
        F.when(doc % 67 == 3, F.lit("\nColumns are ticket_id and created_at")).otherwise(""),
        F.coalesce(F.concat(F.lit("\nA ticket says: "), "_quoted"), F.lit("")),
    )
    return (
        _documents(spark, sf_dir)
        .withColumn("_home", (doc % 5).cast("int"))
        .join(neighbours, "_home")
        .join(quoted, doc == F.col("event_id"), "left")
        .select(
            "batch_id",
            "company_id",
            F.when(doc % 59 == 7, F.lit(" \n "))
            .otherwise(F.concat(F.lit("  \n"), body, added, F.lit("\n ")))
            .alias("text"),
        )
    )


def recommendation_drafts(
    spark: SparkSession, sf_dir: str, evidence: DataFrame, *, refined: bool = False
) -> DataFrame:
    """One to four drafts per document; after refinement, for every third document, others."""
    doc, pos = F.col("batch_id"), F.col("pos")
    kind = (doc + 1 + pos * (doc % 2)) % 6 if refined else (doc + pos * (doc % 3 + 1)) % 6
    category = _pick(("view", "click", "purchase", OUTSIDE, "signup", "view"), kind)
    lines = F.col("allowed_numeric_evidence")
    both = F.array(F.element_at(lines, 1), F.element_at(lines, 6))
    usual = F.when(lines.isNull(), F.array(F.lit("Ticket count: 1"), F.lit("Automation score: 50.00/100")))
    if refined:
        cited = usual.when(doc % 10 == 0, F.array(F.lit("No such line"), F.element_at(lines, 1))).otherwise(both)
    else:
        cited = (
            usual.when(doc % 7 == 0, F.array(F.element_at(lines, 1), F.lit("Automation score: 0.01/100")))
            .when(doc % 11 == 0, F.array(F.element_at(lines, 6)))
            .otherwise(both)
        )
    benefits = (
        F.when(doc % 47 == 0, F.array().cast("array<string>"))
        .when(doc % 13 == 0, F.array(F.lit("Guaranteed savings")))
        .otherwise(F.array(F.lit("Faster replies"), F.lit("Fewer repeated steps")))
    )
    drafts = doc % 4 + 1
    rows = _documents(spark, sf_dir)
    if refined:
        rows = rows.filter(doc % 3 == 0)
    base = rows.select(
        "batch_id",
        "company_id",
        F.split("text", "\n").alias("_lines"),
        F.explode(F.sequence(F.lit(0), (doc % 4).cast("int"))).alias("pos"),
    ).select(
        "batch_id",
        "pos",
        "company_id",
        category.alias("category"),
        F.array_join(_part(F.col("_lines"), drafts, pos), " ").alias("current_workflow"),
    )
    opening = "Refined: assist with " if refined else "Assist with "
    return base.join(
        evidence.select("company_id", "category", "allowed_numeric_evidence"), ["company_id", "category"], "left"
    ).select(
        "batch_id",
        "pos",
        "company_id",
        "category",
        F.when(doc % 53 == 0, "").otherwise(F.concat(F.lit(opening), "category")).alias("title"),
        "current_workflow",
        F.concat(F.lit("Draft replies for "), "category").alias("proposed_automation"),
        cited.alias("evidence"),
        benefits.alias("expected_benefits"),
        F.array(F.lit("Model assumption: tools stay available")).alias("assumptions"),
        F.array(F.concat(F.lit("Wrong routing in "), "category")).alias("risks"),
        F.array(F.lit("An agent confirms each reply")).alias("human_review_points"),
        F.when(doc % 43 == 0, "certain").otherwise(_pick(("low", "medium", "high"), doc % 3)).alias("confidence"),
    )


def question_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to four questions per document."""
    doc, pos = F.col("batch_id"), F.col("pos")
    turn = (doc + pos) % 8
    opening = (
        F.when(turn == 0, "What is the average resolution time of this:")
        .when(turn == 1, "Please PROVIDE more information about this:")
        .when(turn == 2, "Which systems are used for this:")
        .otherwise("Who approves this request:")
    )
    category = _pick(CATEGORIES, (doc + pos) % 5)
    number = F.expr("batch_id DIV 2 % 5").cast("int")
    base = (
        _documents(spark, sf_dir)
        .filter(number > 0)
        .select(
            "batch_id",
            "company_id",
            F.split("text", "\n").alias("_lines"),
            number.alias("_number"),
            F.explode(F.sequence(F.lit(0), number - 1)).alias("pos"),
        )
    )
    return base.select(
        "batch_id",
        "pos",
        F.when(doc % 41 == 0, "Q 0")
        .otherwise(F.concat(F.lit("q"), F.expr("pos DIV (1 + batch_id % 2)").cast("string")))
        .alias("question_id"),
        F.concat_ws(" ", opening, F.array_join(_part(F.col("_lines"), F.col("_number"), pos), " ")).alias("question"),
        F.when((doc + pos) % 29 == 0, "Short").otherwise("The answer changes the approval path.").alias("rationale"),
        F.when((doc + pos) % 9 == 0, F.array(category, F.lit(OUTSIDE))).otherwise(F.array(category)).alias("related_categories"),
        F.when(pos % 2 == 0, doc % 2 == 0).alias("required"),
        "company_id",
    )


def clarification_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four answers per document in the order of the submission, ``pos``."""
    doc, pos = F.col("batch_id"), F.col("pos")
    number = F.when(doc % 2 == 0, pos).otherwise(3 - pos)
    base = _documents(spark, sf_dir).select(
        "batch_id", F.split("text", "\n").alias("_lines"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")
    )
    return base.select(
        "batch_id",
        "pos",
        F.when(number == 3, "q-other").otherwise(F.concat(F.lit("q"), number.cast("string"))).alias("question_id"),
        F.when((doc + pos) % 10 == 0, " \t ")
        .when((doc % 16 == 6) & (number == 0), "Our Handling Hours are 7.")
        .otherwise(F.concat(F.lit("  "), F.array_join(_part(F.col("_lines"), F.lit(4), pos), " "), F.lit("\n")))
        .alias("answer"),
    )


def process_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four or five analyses per document, one per category unless it is defective."""
    doc, pos = F.col("batch_id"), F.col("pos")
    category = (
        F.when((pos == 0) & (doc % 12 == 0), OUTSIDE)
        .when((pos == 0) & (doc % 12 == 6), _pick(CATEGORIES, (doc + 1) % 5))
        .otherwise(_pick(CATEGORIES, (doc + pos) % 5))
    )
    last = F.when(doc % 13 == 0, 3).otherwise(4)
    base = _documents(spark, sf_dir).select(
        "batch_id",
        "company_id",
        "source",
        "lang",
        F.split("text", "\n").alias("_lines"),
        F.explode(F.sequence(F.lit(0), last)).alias("pos"),
    )
    return base.select(
        "batch_id",
        "pos",
        "company_id",
        category.alias("category"),
        _part(F.col("_lines"), F.lit(5), pos).alias("repetitive_steps"),
        F.array(F.concat(F.lit("Desk "), "source")).alias("systems_used"),
        F.array(F.concat(F.lit("Language "), "lang")).alias("exception_cases"),
        F.when((doc + pos) % 47 != 0, doc % 2 == 0).alias("human_approval_required"),
        F.array().cast("array<string>").alias("observations"),
    )


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial narratives, and for every third document those after refinement; some are empty."""
    doc, lines = F.col("batch_id"), F.split("text", "\n")
    refined = doc % 3 == 0
    return _documents(spark, sf_dir).select(
        "batch_id",
        F.when(doc % 71 == 0, "").otherwise(F.concat(F.lit("Report: "), "text")).alias("initial_summary"),
        lines.alias("initial_limitations"),
        F.when(refined, F.concat(F.lit("Refined: "), "text")).alias("refined_summary"),
        F.when(refined, F.transform(lines, lambda x: F.concat(F.lit("Limit: "), x))).alias("refined_limitations"),
    )


def as_documents(rows: DataFrame, entries: str, schema: T.StructType, batches: DataFrame) -> DataFrame:
    """The entries of each batch as one JSON text, at most five; some cut off, incomplete or of a wrong type."""
    batch = F.col("batch_id")
    entry = F.struct(*schema.fieldNames())
    ordered = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))
    lists = rows.groupBy("batch_id").agg(F.transform(ordered, lambda e: e["entry"]).alias(entries))
    none = F.array().cast(lists.schema[entries].dataType)
    joined = batches.select("batch_id").join(lists, "batch_id", "left").withColumn(entries, F.coalesce(entries, none))
    text = F.to_json(F.struct(entries))
    first = schema.fieldNames()[0]
    return joined.select(
        "batch_id",
        F.when(batch % 19 == 1, F.substring(text, 1, 12))
        .when(batch % 23 == 1, F.lit('{"answer": "no list"}'))
        .when(batch % 29 == 1, F.regexp_replace(text, f'"{first}":"', f'"{first}":[],"was":"'))
        .otherwise(text)
        .alias("document"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("batch_id", "company_id")


def narrative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The initial narratives as JSON texts, with the same defects as other documents."""
    batch = F.col("batch_id")
    text = F.to_json(
        F.struct(F.col("initial_summary").alias("executive_summary"), F.col("initial_limitations").alias("limitations"))
    )
    return narratives(spark, sf_dir).select(
        "batch_id",
        F.when(batch % 19 == 1, F.substring(text, 1, 12))
        .when(batch % 23 == 1, F.lit('{"answer": "no list"}'))
        .when(batch % 29 == 1, F.regexp_replace(text, '"executive_summary":"', '"executive_summary":[],"was":"'))
        .otherwise(text)
        .alias("document"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the details of answers, where they have any."""
    details = F.struct(
        F.col("text").alias("answer"),
        F.array(F.lit("Ticket count: 1")).alias("evidence_used"),
        F.array().cast("array<string>").alias("assumptions"),
        F.array().cast("array<string>").alias("missing_information"),
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), details).alias("answer_details"),
    )


def chat_answers(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    """One answer per assistant turn of a conversation that has a document, in seven kinds.

    Kinds cite a fact, an invented line, a bullet or an analysis of the own batch, or a bullet of
    another batch of the same company.
    """
    conv, kind = F.col("batch_id"), F.col("kind")
    number = F.col("conv_id") + F.col("turn")
    first = F.element_at(F.split("text", "\n"), 1)
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("batch_id"), first.alias("_own"))
    other = table(spark, sf_dir, "documents").select((F.col("doc_id") - 5).alias("batch_id"), first.alias("_other"))
    base = (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            F.col("conv_id").alias("batch_id"),
            "turn",
            "text",
            (number % 7).alias("kind"),
            _pick(CATEGORIES, number % 5).alias("category"),
        )
        .join(own, "batch_id")
        .join(other, "batch_id", "left")
    )
    first_line = evidence.select(
        "company_id", "category", F.element_at("allowed_numeric_evidence", 1).alias("line")
    )
    none = F.array().cast("array<string>")
    ending = (
        F.when(kind == 0, F.concat(F.lit(" "), "line")).when(kind == 4, " That is 42.5% of all.").otherwise("")
    )
    bullet = "Process documentation — **Manual steps:** "
    return (
        _with_company(spark, sf_dir, base, conv)
        .join(first_line, ["company_id", "category"], "left")
        .withColumn("line", F.coalesce("line", F.lit("No line")))
        .select(
            "batch_id",
            "turn",
            "company_id",
            F.when((conv + F.col("turn")) % 23 == 5, " \n").otherwise("What does the evidence say?").alias("question"),
            F.concat("text", ending, F.when(conv % 9 == 0, " Guaranteed.").otherwise("")).alias("answer"),
            F.when(kind == 1, F.array(F.lit("Invented fact")))
            .when(kind.isin(0, 4), F.array("line"))
            .when(kind == 2, F.array(F.concat(F.lit(bullet), "_own")))
            .when(kind == 5, F.array("line", F.concat(F.lit(bullet), F.coalesce("_other", F.lit("none")))))
            .when(
                kind == 6,
                F.array(
                    F.concat(
                        F.lit("Process documentation — "),
                        _pick(CATEGORIES, conv % 5),
                        F.lit(" — repetitive step: "),
                        "_own",
                    )
                ),
            )
            .otherwise(none)
            .alias("evidence_used"),
            F.when((kind == 3) & (conv % 2 == 0), F.array(F.lit("Volumes will grow")))
            .otherwise(F.array(F.lit("Model assumption: volumes stay")))
            .alias("assumptions"),
            F.when((kind == 3) & (conv % 4 < 3), F.array(F.lit("Volume by region"))).otherwise(none).alias("missing_information"),
        )
    )


def chat_answer_documents(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    """Chat answers as JSON texts, some without a list or of a wrong type."""
    number = F.col("batch_id") + F.col("turn")
    text = F.to_json(F.struct("answer", "evidence_used", "assumptions", "missing_information"))
    return chat_answers(spark, sf_dir, evidence).select(
        "batch_id",
        "turn",
        F.when(number % 11 == 1, F.regexp_replace(text, '"assumptions":', '"assumed":'))
        .when(number % 13 == 1, F.regexp_replace(text, '"evidence_used":\\[', '"evidence_used":[[],'))
        .when(number % 17 == 1, F.regexp_replace(text, '"answer":"', '"answer":"","was":"'))
        .otherwise(text)
        .alias("document"),
    )
