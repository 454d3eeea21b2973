"""One registered query per operator, over whole tables; small shared results are staged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.fixed_values import CHAT_ROLES, FORBIDDEN_CLAIM
from ticketlens.functions.sql import ARGUMENTS as SQL_ARGUMENTS
from ticketlens.functions.sql import register as register_functions
from ticketlens.operators import catalog as ca
from ticketlens.operators import chat as ch
from ticketlens.operators import drafts as dr
from ticketlens.operators import evidence as ev
from ticketlens.operators import hashtree as ht
from ticketlens.operators import metrics as me
from ticketlens.operators import presentation as pr
from ticketlens.operators import quality as qu
from ticketlens.operators import questions as qs
from ticketlens.operators import recommendations as rc
from ticketlens.operators import report as rp
from ticketlens.operators import scoring as sc
from ticketlens.plans import audit, grounded, intake, maintained
from ticketlens.session import at_once, shared_folder, staged, staged_by
from ticketlens.sources import companies as co
from ticketlens.sources import documents as do
from ticketlens.sources import folders as fo
from ticketlens.sources import nested
from ticketlens.sources import schemas as sm
from ticketlens.sources import tickets as ti
from ticketlens.workloads import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Sources and sinks ------------------------------------------------------------


@query
def scan_tickets(spark, sf):
    path = shared_folder(spark, "raw-tickets")
    ti.write_ticket_files(tb.raw_tickets(spark, sf), path)
    return ti.read_ticket_folder(spark, path).drop(ti.CORRUPT)


@query
def tickets_csv_roundtrip(spark, sf):
    path = shared_folder(spark, "tickets")
    ti.write_ticket_files(tb.tickets(spark, sf), path)
    checked = qu.with_violations(ti.read_ticket_folder(spark, path), tb.factors(spark))
    return qu.normalized(checked)


@query
def ticket_file_findings(spark, sf):
    """Files of a folder by verdict, with the rows read from the good ones."""
    folder = shared_folder(spark, "ticket-files")
    tb.ticket_files(spark, sf, folder)
    rows, findings = fo.read_folder_apart(spark, folder)
    counted = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("tickets")).withColumn("verdict", F.lit(fo.OK))
    files = findings.groupBy("company_id", "verdict", "detail").agg(F.count(F.lit(1)).alias("files"))
    return files.join(counted, ["company_id", "verdict"], "left").select(
        "company_id", "verdict", "detail", "files", F.coalesce("tickets", F.lit(0)).alias("tickets")
    )


@query
def ticket_view(spark, sf):
    """The tickets under a SQL name, read with plain SQL."""
    tb.tickets(spark, sf).createOrReplaceTempView("tickets")
    return spark.sql(
        "SELECT company_id, count(*) AS ticket_count, min(created_at) AS first_ticket, "
        "max(created_at) AS last_ticket FROM tickets GROUP BY company_id"
    )


@query
def scan_companies(spark, sf):
    path = shared_folder(spark, "companies")
    co.write_companies(tb.raw_companies(spark, sf), path)
    return co.read_companies(spark, path)


@query
def company_contract(spark, sf):
    checked = co.apply_company_contract(tb.raw_companies(spark, sf))
    return checked.select(
        F.col("id").alias("company_id"),
        "ticket_count",
        "demo_status",
        F.array_join("violations", "; ").alias("violations"),
    )


@query
def scan_process_docs(spark, sf):
    documents = do.stripped_documents(tb.process_documents(spark, sf))
    return documents.select("batch_id", "company_id", "text", "is_empty")


@query
def unknown_companies(spark, sf):
    """Tickets ask for companies and documents for their sources; no source is a company."""
    requests = tb.tickets(spark, sf).select("company_id").unionByName(
        tb.table(spark, sf, "documents").select(F.col("source").alias("company_id"))
    )
    return co.unknown_companies(requests, tb.company_ids(spark, sf))


@query
def evidence_json(spark, sf):
    """Company evidence written as JSON, read back and laid out flat."""
    path = shared_folder(spark, "evidence")
    done = _audit(spark, sf)
    frame = ev.company_evidence(
        done.evidence, me.overall_metrics(done.cube), _companies(spark, sf)
    )
    nested.write_json(frame, path)
    entries = spark.read.schema(frame.schema).json(path).select(
        "company_id", "audit_summary.total_ticket_count", F.inline("categories")
    )
    return entries.select(
        "company_id",
        "total_ticket_count",
        "rank",
        "metrics.category",
        "metrics.automation_score",
        F.array_join("allowed_numeric_evidence", "; ").alias("facts"),
    )


# Contract ---------------------------------------------------------------------


def _checked(spark, sf):
    return qu.with_violations(tb.raw_tickets(spark, sf), tb.factors(spark))


@query
def dq_row_violations(spark, sf):
    return qu.quarantine(_checked(spark, sf)).select(
        "company_id",
        "created_at",
        "description",
        "ticket_id",
        F.array_join("violations", "; ").alias("violations"),
    )


@query
def dq_duplicate_keys(spark, sf):
    return qu.duplicate_keys(tb.raw_tickets(spark, sf))


@query
def dq_unknown_category(spark, sf):
    return qu.unknown_categories(tb.raw_tickets(spark, sf), tb.factors(spark))


@query
def dq_report(spark, sf):
    """Findings of all companies, and of one that has no tickets."""
    ids = tb.company_ids(spark, sf)
    expected = ids.union(ids.limit(1).select(F.lit("no tickets"))).distinct()
    return qu.quality_report(_checked(spark, sf), expected)


@query
def ticket_intake(spark, sf):
    """The report, the rows kept and set aside by company, and the totals over all, from one pass over the cells."""
    done = intake.take_in(tb.raw_tickets(spark, sf), tb.factors(spark), tb.company_ids(spark, sf), shared_folder(spark, "intake"))

    def counted(rows, number, name):
        by_company = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("findings"))
        return by_company.select("company_id", F.lit(number).alias("check_no"), F.lit(name).alias("check"), "findings")

    totals = spark.createDataFrame(
        [("all companies", 9, name, number) for name, number in done.totals.items()], done.report.schema
    )
    return reduce(DataFrame.unionByName, (done.report, counted(done.good, 7, "kept"), counted(done.set_aside, 8, "set aside"), totals))


@query
def normalized_tickets(spark, sf):
    return qu.normalized(_checked(spark, sf))


# Metrics ----------------------------------------------------------------------


@query
def overall_metrics(spark, sf):
    return me.overall_metrics(tb.cube(spark, sf))


@query
def category_metrics(spark, sf):
    return me.category_metrics(tb.cube(spark, sf, "category"))


@query
def category_share(spark, sf):
    return me.category_shares(tb.cube(spark, sf, "category"))


@query
def volume_ratio(spark, sf):
    return me.volume_ratios(me.category_shares(tb.cube(spark, sf, "category")))


@query
def escalation_rate(spark, sf):
    return me.escalation_rates(tb.cube(spark, sf, "category"))


@query
def channel_counts(spark, sf):
    return me.dimension_counts(tb.cube(spark, sf, "channel"), "channel")


@query
def tier_counts(spark, sf):
    return me.dimension_counts(tb.cube(spark, sf, "customer_tier"), "customer_tier")


@query
def support_summary(spark, sf):
    return me.support_summary(tb.cube(spark, sf, *me.DIMENSIONS))


@query
def maintained_audit(spark, sf):
    """The summary from a state to which half of the tickets was added after the other, file by file."""
    folder, state = shared_folder(spark, "stored-tickets"), shared_folder(spark, "audit-state")
    tickets = tb.tickets(spark, sf)
    early = F.crc32(F.col("ticket_id").cast("binary")) % 2 == 0
    for half in (tickets.filter(early), tickets.filter(~early)):
        half.write.mode("append").partitionBy("company_id").parquet(folder)
        maintained.refresh(spark, state, folder)
    return me.support_summary(maintained.cube(spark, state, folder))


@query
def registry_audit(spark, sf):
    """Totals of the companies that the registry lists under every other number; only their stored files are read."""
    folder = shared_folder(spark, "stored-tickets")
    tb.tickets(spark, sf).write.partitionBy("company_id").parquet(folder)
    asked = tb.regions(spark, sf).filter("region_key % 2 = 0")
    return me.overall_metrics(me.ticket_cube(ti.tickets_of(spark, folder, asked), ()))


# Scoring, ranking, presentation -----------------------------------------------


def _scored(spark, sf):
    return audit.scored_metrics(tb.cube(spark, sf, "category"), tb.factors(spark))


def _ranked(spark, sf):
    return sc.ranked(_scored(spark, sf))


@query
def factor_join(spark, sf):
    """Raw categories with their factors; unknown ones stay, marked."""
    counted = tb.raw_tickets(spark, sf).groupBy("company_id", "category").agg(
        F.count(F.lit(1)).alias("ticket_count")
    )
    return sc.with_factors(counted, tb.factors(spark))


@query
def automation_score(spark, sf):
    return _scored(spark, sf).select("company_id", "category", "automation_score")


@query
def score_in_sql(spark, sf):
    """Score and explanation by functions of SQL."""
    register_functions(spark)
    joined = sc.with_factors(me.category_metrics(tb.cube(spark, sf, "category")), tb.factors(spark))
    joined.createOrReplaceTempView("category_metrics")
    arguments = ", ".join(a.split(" ")[0] for a in SQL_ARGUMENTS.split(", "))
    return spark.sql(
        f"SELECT company_id, category, automation_score({arguments}) AS automation_score, "
        f"automation_explanation({arguments}) AS explanation FROM category_metrics"
    )


@query
def opportunity_ranking(spark, sf):
    return _ranked(spark, sf).select(
        "company_id", "category", "ticket_count", "automation_score", "rank"
    )


@query
def opportunity_explanations(spark, sf):
    return _ranked(spark, sf).select("company_id", "category", "explanation")


@query
def highest_volume(spark, sf):
    return sc.highest_volume(me.category_shares(tb.cube(spark, sf, "category")))


@query
def highest_automation(spark, sf):
    return sc.highest_automation(_ranked(spark, sf))


@query
def overview_argmax(spark, sf):
    return sc.overview_extremes(_scored(spark, sf))


@query
def top3_opportunities(spark, sf):
    return sc.top_opportunities(_ranked(spark, sf)).select(
        "company_id", "rank", "category", "automation_score"
    )


@query
def remaining_opportunities(spark, sf):
    return sc.remaining_opportunities(_ranked(spark, sf)).select(
        "company_id", "rank", "category", "automation_score"
    )


@query
def score_bands(spark, sf):
    return pr.ranking_cards(_ranked(spark, sf))


@query
def sorted_tickets(spark, sf):
    return pr.ticket_order(tb.tickets(spark, sf))


@query
def chart_series(spark, sf):
    return pr.chart_series(_scored(spark, sf))


@query
def metrics_table(spark, sf):
    return pr.metrics_table(_scored(spark, sf))


@query
def headline_cards(spark, sf):
    cube = staged(tb.cube(spark, sf, "category"), "cube")
    scored = audit.scored_metrics(cube, tb.factors(spark))
    return pr.headline_cards(me.overall_metrics(cube), sc.overview_extremes(scored))


@query
def company_caption(spark, sf):
    return pr.company_captions(co.apply_company_contract(tb.raw_companies(spark, sf)))


# Evidence ---------------------------------------------------------------------


@query
def evidence_lines(spark, sf):
    return ev.evidence_lines(_ranked(spark, sf))


@query
def evidence_package(spark, sf):
    """The package of every company laid out flat, one row per category."""
    cube = staged(tb.cube(spark, sf, "category"), "cube")
    overall = me.overall_metrics(cube).withColumnRenamed(
        "total_handling_hours", "overall_handling_hours"
    )
    return (
        ev.category_evidence(audit.opportunities(cube, tb.factors(spark)))
        .withColumn("allowed_numeric_evidence", F.array_join("allowed_numeric_evidence", "; "))
        .join(overall, "company_id")
    )


def _companies(spark, sf):
    return co.apply_company_contract(tb.raw_companies(spark, sf)).drop("violations")


@dataclass(frozen=True)
class _Audit:
    """What a query needs in several places, computed once and staged."""

    cube: DataFrame
    opportunities: DataFrame

    @property
    def evidence(self) -> DataFrame:
        return ev.category_evidence(self.opportunities)


def _audit(spark, sf) -> _Audit:
    cube = staged(tb.cube(spark, sf, "category"), "cube")
    ranked = audit.opportunities(cube, tb.factors(spark))
    return _Audit(cube, staged(ranked, "opportunities"))


def _company_evidence(spark, sf, done):
    """One row per company, written once: joins then know its size."""
    frame = ev.company_evidence(
        done.evidence, me.overall_metrics(done.cube), _companies(spark, sf)
    )
    return staged(frame, "company-evidence")


def _documents(spark, sf):
    return do.stripped_documents(tb.process_documents(spark, sf)).drop("is_empty")


def _packages(spark, sf, done=None):
    per_company = _company_evidence(spark, sf, done or _audit(spark, sf))
    return ev.evidence_packages(per_company, _documents(spark, sf), ["batch_id"])


@query
def evidence_row_free(spark, sf):
    """Column names and id prefixes of raw tickets, and texts of tickets, in packages."""
    sf = tb.by_batch(spark, sf)
    named = ev.raw_row_mentions(_packages(spark, sf), ["batch_id"], ("ticket_id", "created_at", "TKT-"))
    quoted = (
        ev.quoted_tickets(_documents(spark, sf), ["batch_id"], tb.tickets(spark, sf).select("description"))
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).cast("int").alias("quoted"))
    )
    found = F.col("markers_found") + F.coalesce("quoted", F.lit(0))
    return named.join(quoted, "batch_id", "left").select(
        "batch_id", "company_id", found.alias("markers_found"), (found == 0).alias("row_free")
    )


@query
def evidence_isolation(spark, sf):
    return ev.foreign_mentions(_documents(spark, sf), ["batch_id"], tb.company_ids(spark, sf))


@query
def evidence_checksum(spark, sf):
    """Evidence as first packed, and as the contexts hold it after refinement, some of them tampered with."""
    done = _audit(spark, sf)
    results = _Results(spark, sf, done).ready()
    parts = F.to_json(F.struct(*grounded.EVIDENCE), {"ignoreNullFields": "false"}).alias("package")
    packed = _documents(spark, results.sf).join(results.per_company, "company_id").select(
        "batch_id",
        F.col("company.name").alias("company_name"),
        "audit_summary",
        F.col("categories").alias("category_evidence"),
        "scoring_methodology",
        F.col("text").alias("process_documentation"),
    )
    before = ev.checksums(packed.select("batch_id", parts), ["batch_id"])
    altered = F.when(F.col("batch_id") % 37 == 4, F.concat("process_documentation", F.lit("."))).otherwise(
        F.col("process_documentation")
    )
    later = results.contexts().withColumn("process_documentation", altered)
    after = ev.checksums(later.select("batch_id", parts), ["batch_id"]).withColumnRenamed("checksum", "after")
    refined = results.reports().select("batch_id", "refined")
    return (
        before.join(after, "batch_id")
        .join(refined, "batch_id")
        .select("batch_id", "refined", F.col("checksum").eqNullSafe(F.col("after")).alias("unchanged"))
    )


@query
def evidence_changes(spark, sf):
    """Which parts of the evidence differ from a later state, in which some were tampered with.

    Later, one document in 37 has a further line, one in 41 another first line, and one company's score of one category is higher. The
    companies' parts are hashed once per company, not per document.
    """
    evidence = staged(_audit(spark, sf).evidence, "evidence")
    documents = _documents(spark, sf)

    def states(evidence, documents):
        entry = ht.leaf(F.col("category"), F.to_json(F.struct(*ev.METRIC_COLUMNS, "deterministic_explanation", "allowed_numeric_evidence")))
        categories = evidence.groupBy("company_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        of_company = staged(categories.select("company_id", ht.parts({"categories": F.col("entries")}).alias("own")), "company-parts")
        of_document = documents.select("batch_id", "company_id", ht.parts({"process_documentation": ht.lines(F.col("text"))}).alias("parts"))
        both = of_document.join(of_company, "company_id").withColumn("parts", F.concat("own", "parts"))
        return both.select("batch_id", ht.root(F.col("parts")).alias("root"), "parts")

    higher = (F.col("company_id") == "asia") & (F.col("category") == "view")
    tampered = evidence.withColumn("automation_score", F.when(higher, F.col("automation_score") + 1).otherwise(F.col("automation_score")))
    text = F.when(F.col("batch_id") % 41 == 3, F.concat(F.lit("Note: "), "text")).otherwise(F.col("text"))
    text = F.when(F.col("batch_id") % 37 == 4, F.concat(text, F.lit("\ntampered"))).otherwise(text)
    return ht.changes(states(evidence, documents), states(tampered, documents.withColumn("text", text)), ["batch_id"])


@query
def process_bullets(spark, sf):
    return do.process_bullets(_documents(spark, sf), ["batch_id", "company_id"])


@query
def process_sections(spark, sf):
    return do.process_sections(_documents(spark, sf), ["batch_id", "company_id"])


@query
def evidence_catalog(spark, sf):
    """The catalog of every complete audit result, one line a row."""
    return ca.catalog_lines(_Results(spark, sf).ready().contexts())


@query
def read_documents(spark, sf):
    """Process documents written as one file each by batch, and read back as whole texts."""
    path = shared_folder(spark, "documents")
    do.write_documents(tb.process_documents(spark, sf), path, "batch_id")
    number = F.regexp_extract("path", "batch_id=(-?[0-9]+)", 1).cast("bigint")
    read = do.read_documents(spark, path, nested=True).select(number.alias("batch_id"), "text")
    return do.stripped_documents(read)


# Grounding rules --------------------------------------------------------------


def _verified(spark, sf, done=None, *, refined=False):
    evidence = (done or _audit(spark, sf)).evidence
    drafts = tb.recommendation_drafts(spark, sf, evidence, refined=refined)
    return rc.verify_recommendations(drafts, evidence)


def _parsed(spark, sf, rows, entries, schema):
    inner = schema[entries].dataType.elementType
    documents = tb.as_documents(rows, entries, inner, tb.batches(spark, sf))
    return dr.parse_documents(documents, schema)


def _parsed_recommendations(spark, sf):
    drafts = tb.recommendation_drafts(spark, sf, _audit(spark, sf).evidence)
    return _parsed(spark, sf, drafts, "recommendations", sm.RECOMMENDATION_BATCH)


def _parsed_questions(spark, sf):
    return _parsed(spark, sf, tb.question_drafts(spark, sf), "questions", sm.QUESTION_BATCH)


def _parsed_analyses(spark, sf):
    return _parsed(spark, sf, tb.process_analyses(spark, sf), "analyses", sm.PROCESS_ANALYSIS_BATCH)


def _parsed_narratives(spark, sf):
    return dr.parse_documents(tb.narrative_documents(spark, sf), sm.NARRATIVE)


def _parsed_chat_answers(spark, sf):
    documents = tb.chat_answer_documents(spark, sf, _audit(spark, sf).evidence)
    return dr.parse_documents(documents, sm.CHAT_ANSWER)


def _sizes(parsed, entries):
    size = F.when(F.col("status") == "ok", F.size(f"parsed.{entries}")).alias("entries")
    return parsed.select("batch_id", "status", size)


@query
def parse_drafts(spark, sf):
    return _sizes(_parsed_recommendations(spark, sf), "recommendations")


@query
def parse_questions(spark, sf):
    return _sizes(_parsed_questions(spark, sf), "questions")


@query
def parse_analyses(spark, sf):
    return _sizes(_parsed_analyses(spark, sf), "analyses")


@query
def parse_narratives(spark, sf):
    return _sizes(_parsed_narratives(spark, sf), "limitations")


@query
def parse_chat_answers(spark, sf):
    return _parsed_chat_answers(spark, sf).select("batch_id", "turn", "status")


@query
def parse_findings(spark, sf):
    """Where each machine-written document departs from its declared form."""
    kinds = {
        "recommendations": _parsed_recommendations(spark, sf),
        "questions": _parsed_questions(spark, sf),
        "analyses": _parsed_analyses(spark, sf),
        "narrative": _parsed_narratives(spark, sf),
        "chat answer": _parsed_chat_answers(spark, sf),
    }
    found = [
        dr.document_findings(parsed, [c for c in ("batch_id", "turn") if c in parsed.columns]).withColumn("kind", F.lit(kind))
        for kind, parsed in kinds.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


@query
def draft_contract(spark, sf):
    rows = dr.explode_batch(_parsed_recommendations(spark, sf), ["batch_id"], "recommendations")
    return dr.batch_contract(rows, dr.recommendation_bounds(), ["batch_id"])


@query
def question_contract(spark, sf):
    rows = dr.explode_batch(_parsed_questions(spark, sf), ["batch_id"], "questions")
    return dr.batch_contract(rows, dr.question_bounds(), ["batch_id"])


@query
def question_entries(spark, sf):
    """Questions as parsed; one that doesn't say so isn't required."""
    rows = dr.explode_batch(_parsed_questions(spark, sf), ["batch_id"], "questions")
    return rows.select("batch_id", "pos", "question_id", "required")


@query
def analysis_contract(spark, sf):
    rows = dr.explode_batch(_parsed_analyses(spark, sf), ["batch_id"], "analyses")
    return dr.batch_contract(rows, dr.analysis_bounds(), ["batch_id"], limit=None)


@query
def narrative_contract(spark, sf):
    rows = dr.single_entries(_parsed_narratives(spark, sf), ["batch_id"])
    checked = dr.with_broken_bounds(rows, dr.narrative_bounds())
    return checked.select("batch_id", F.array_join("broken", "; ").alias("broken"))


@query
def chat_answer_contract(spark, sf):
    rows = dr.single_entries(_parsed_chat_answers(spark, sf), ["batch_id", "turn"])
    checked = dr.with_broken_bounds(rows, dr.chat_answer_bounds())
    return checked.select("batch_id", "turn", F.array_join("broken", "; ").alias("broken"))


@query
def turn_contract(spark, sf):
    """Turns whose role or content breaks the declared bounds."""
    checked = dr.with_broken_bounds(tb.chat_turns(spark, sf), dr.turn_bounds())
    return checked.filter(F.size("broken") > 0).select(
        "conv_id", "turn", F.array_join("broken", "; ").alias("broken")
    )


@query
def verify_recommendations(spark, sf):
    return _verified(spark, sf).select(
        "batch_id", "pos", "company_id", "category", "verdict"
    )


@query
def verify_refined(spark, sf):
    return _verified(spark, sf, refined=True).select(
        "batch_id", "pos", "company_id", "category", "verdict"
    )


@query
def recommendation_issues(spark, sf):
    return rc.issues(_verified(spark, sf))


@query
def batch_gate(spark, sf):
    return rc.batch_gate(_verified(spark, sf))


def _questions(spark, sf, done=None):
    categories = qs.company_categories((done or _audit(spark, sf)).evidence)
    return qs.verify_questions(tb.question_drafts(spark, sf), categories)


@query
def verify_questions(spark, sf):
    return _questions(spark, sf).select(
        "batch_id", "pos", "company_id", "question_id", "verdict", "issue"
    )


def _answers(spark, sf, done=None):
    accepted = _questions(spark, sf, done).filter(F.col("verdict") == "accepted")
    return qs.verify_answers(tb.clarification_answers(spark, sf), accepted)


@query
def clarification_answers(spark, sf):
    return _answers(spark, sf).select(
        "batch_id", "pos", "question_id", "answer", "question", "source_label", "verdict", "issue"
    )


def _coverage(spark, sf, done=None):
    audited = (done or _audit(spark, sf)).opportunities
    return rp.process_coverage(tb.process_analyses(spark, sf), audited)


class _Results:
    """Grounded results of all batches; what several parts of a query read is staged once.

    ``sf`` is the folder with its documents laid out by batch. What has texts is staged in the same buckets.
    """

    def __init__(self, spark, sf, done=None):
        self.spark, self.sf, self.done = spark, tb.by_batch(spark, sf), done or _audit(spark, sf)

    def laid(self, frame, name):
        return staged_by(frame, name, "batch_id", self.sf.parts)

    def stage(self, *names):
        """Stage these parts at the same time; none of them may need another one that isn't there yet."""
        at_once(self.spark, *(lambda name=name: getattr(self, name) for name in names))

    def ready(self):
        """All parts of a context, in two rounds by what they need."""
        self.stage("verified", "redone", "answers", "coverage", "per_company", "history")
        self.stage("completeness", "refined", "analyses")
        return self

    @cached_property
    def per_company(self):
        return _company_evidence(self.spark, self.sf, self.done)

    @cached_property
    def analyses(self):
        lists = grounded.analysis_lists(tb.process_analyses(self.spark, self.sf), self.coverage)
        return self.laid(lists, "analyses")

    @cached_property
    def history(self):
        turns = tb.chat_turns(self.spark, self.sf).filter(F.col("role").isin(*CHAT_ROLES))
        lists = ch.history_lists(ch.bounded_history(turns)).withColumnRenamed("conv_id", "batch_id")
        return staged(lists, "history")

    @cached_property
    def verified(self):
        return self.laid(_verified(self.spark, self.sf, self.done), "verified")

    @cached_property
    def answers(self):
        return self.laid(_answers(self.spark, self.sf, self.done), "answers")

    @cached_property
    def coverage(self):
        return staged(_coverage(self.spark, self.sf, self.done), "coverage")

    @cached_property
    def initial(self):
        narratives = tb.narratives(self.spark, self.sf)
        return self.laid(grounded.initial_reports(rc.accepted(self.verified), narratives), "initial")

    @cached_property
    def completeness(self):
        """Parts of each batch: filled document, covered analyses, a report, a question list that stands, be it empty."""
        batches = tb.batches(self.spark, self.sf)
        contract = dr.batch_contract(tb.question_drafts(self.spark, self.sf), dr.question_bounds(), ["batch_id"])
        parts = {
            "evidence": _documents(self.spark, self.sf).filter(F.length("text") > 0),
            "process_analysis": self.coverage.filter("ok AND batch_id IS NOT NULL"),
            "report": self.initial,
            "clarification_questions": batches.join(contract.filter("NOT ok"), "batch_id", "left_anti"),
        }
        return staged(rp.result_completeness(batches, parts), "completeness")

    def rejected(self):
        return self.answers.filter("verdict = 'submission rejected'").select("batch_id").distinct()

    @cached_property
    def redone(self):
        """Verdicts on the drafts after refinement."""
        return self.laid(_verified(self.spark, self.sf, self.done, refined=True), "refined")

    @cached_property
    def refined(self):
        narratives = tb.narratives(self.spark, self.sf)
        return self.laid(grounded.refined_reports(self.redone, narratives, self.rejected()), "refined-reports")

    def reports(self):
        return grounded.active_reports(self.initial, self.refined)

    def contexts(self, complete=None, *, initial=False):
        """Contexts of the complete batches, or of ``complete``; with the report before refinement, if ``initial``."""
        return grounded.contexts(
            self.completeness.filter("ok") if complete is None else complete,
            _documents(self.spark, self.sf),
            self.analyses,
            self.initial if initial else self.reports(),
            grounded.answer_lists(qs.clarifications(self.answers)),
            self.history,
            self.per_company,
        )


@query
def verify_chat_answers(spark, sf):
    """Answers in conversations of complete results against the catalogs of those results."""
    results = _Results(spark, sf).ready()
    complete = results.completeness.filter("ok").select("batch_id")
    answers = tb.chat_answers(spark, results.sf, results.done.evidence).join(complete, "batch_id", "left_semi")
    answers = staged(answers, "chat-answers")
    spoken = complete.join(answers.select("batch_id").distinct(), "batch_id", "left_semi")
    foreign = ch.foreign_lines(answers, results.contexts(spoken))
    return ch.verify_chat_answers(answers, foreign).select("batch_id", "turn", "company_id", "verdict", "issue")


@query
def numeric_tokens(spark, sf):
    return ch.numeric_tokens(tb.table(spark, sf, "documents"), ["doc_id"], "text")


@query
def bounded_history(spark, sf):
    return ch.bounded_history(tb.chat_turns(spark, sf)).drop("answer_details")


@query
def process_coverage(spark, sf):
    return _coverage(spark, sf)


@query
def report_limitations(spark, sf):
    """Limitations of the active report of every complete batch."""
    results = _Results(spark, sf)
    results.stage("verified", "redone", "answers", "coverage")
    results.stage("completeness", "refined")
    reports = results.reports().join(results.completeness.filter("ok"), "batch_id", "left_semi")
    return reports.select("batch_id", "refined", F.posexplode("report_limitations").alias("line_no", "line"))


@query
def staged_issues(spark, sf):
    done = _audit(spark, sf)
    return rp.staged_issues(_verified(spark, sf, done), _questions(spark, sf, done))


@query
def result_complete(spark, sf):
    results = _Results(spark, sf)
    results.stage("verified", "coverage")
    return results.completeness


def _lines_md5(values):
    return F.md5(F.array_join(values, "\n"))


@query
def chat_context(spark, sf):
    """Every complete batch's context in figures, with checksums of its texts in their order."""
    turns = F.col("recent_turns")
    return _Results(spark, sf).ready().contexts().select(
        "batch_id",
        "company_id",
        F.size("process_analysis").alias("analyses"),
        F.size("recommendations").alias("recommendations"),
        _lines_md5(F.transform("recommendations", lambda r: r["title"])).alias("titles_md5"),
        _lines_md5(F.transform("clarification_answers", lambda a: a["answer"])).alias("answers_md5"),
        F.size("clarification_answers").alias("answers"),
        F.md5("executive_summary").alias("summary_md5"),
        _lines_md5("report_limitations").alias("limitations_md5"),
        F.size(turns).alias("turns"),
        F.size(F.filter(turns, lambda t: t["answer_details"].isNotNull())).alias("detailed_turns"),
        _lines_md5(F.transform(turns, lambda t: t["content"])).alias("turns_md5"),
        F.size("evidence_catalog").alias("catalog_lines"),
        _lines_md5("evidence_catalog").alias("catalog_md5"),
    )


@query
def stage_payloads(spark, sf):
    """What each stage's payload holds: counts of its lists, checksums of its texts; null where a part isn't in it."""
    results = _Results(spark, sf).ready()
    held = results.completeness
    asked = tb.chat_answers(spark, results.sf, results.done.evidence).select("batch_id", "turn", "question")
    packed = (
        held.filter("evidence").select("batch_id")
        .join(_documents(spark, results.sf).withColumnRenamed("text", "process_documentation"), "batch_id")
        .join(results.per_company, "company_id")
        .withColumns({"company_name": F.col("company.name"), "category_evidence": F.col("categories")})
    )
    covered = packed.join(results.analyses, "batch_id")
    reported = covered.join(results.initial, "batch_id")
    verified = packed.join(held.filter("process_analysis").select("batch_id"), "batch_id", "left_semi").join(
        grounded.recommendation_lists(rc.accepted(results.verified)), "batch_id"
    )
    answered = results.contexts(initial=True).join(results.rejected(), "batch_id", "left_anti")
    reaching = {
        "process analysis": packed,
        "recommendations": covered,
        "executive report": verified,
        "clarification questions": reported,
        "refinement": answered.filter(F.size("clarification_answers") > 0),
        "chat": grounded.asked(results.contexts(), asked),
    }
    out = []
    for stage, frame in reaching.items():
        rows = grounded.with_payload(grounded.stage_rows(frame, stage), stage)

        def part(name, figure, kind, rows=rows):
            return (figure(F.col(name)) if name in rows.columns else F.lit(None)).cast(kind)

        out.append(
            rows.select(
                "batch_id",
                "company_id",
                "stage_no",
                "stage",
                "turn",
                part("category_evidence", F.size, "int").alias("categories"),
                part("process_documentation", F.md5, "string").alias("documentation_md5"),
                part("process_analysis", F.size, "int").alias("analyses"),
                part("recommendations", F.size, "int").alias("recommendations"),
                part("executive_summary", F.md5, "string").alias("summary_md5"),
                part("clarification_answers", F.size, "int").alias("answers"),
                part("evidence_catalog", F.size, "int").alias("catalog_lines"),
                part("user_question", lambda q: q, "string").alias("user_question"),
                F.contains(F.col("payload"), F.lit(FORBIDDEN_CLAIM)).alias("has_rules"),
            )
        )
    return reduce(DataFrame.unionByName, out)
