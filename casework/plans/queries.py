"""The library's operators as named queries over one folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import replies as rp
from ..operators import envelopes as ev
from ..operators import evals, extraction, history, ledgers, masterdata, phrases, prompts, reconcile, registry, replay, scoring
from ..operators import transcripts as tr
from ..session import run_dir
from ..sources.caseload import DEFAULT_MODEL, DUNNING_LEVELS, Caseload
from ..sources.tables import stream_table
from ..streaming import steps as live
from ..streaming.run import drain, drain_upserts, use_rocksdb
from ..streaming.versions import stream_lookup_versions
from .flow import CaseFlow, Stage, Watch, append_outputs, compose_task, final_summaries, output_rows, prior_contexts, row_priors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def query(fn: Callable[[Caseload], DataFrame]) -> Callable[[Caseload], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Caseload(spark, folder))
    return fn


def stub_model(model_id: str):
    """A stand-in for a model: deterministic, and a plain function of the whole request."""

    def reply(requests):
        users = [r[-1]["content"] for r in requests]
        return [f" {model_id}:{len(u)}:{u.replace(' ', '_')}\n" for u in users]

    return reply


# Envelopes


@query
def envelope_documents(t: Caseload) -> DataFrame:
    return ev.envelope_texts(t.texts(), "content", F.col("source"), custom_ok=True).select("doc_id", "source", "envelope")


@query
def envelope_audit(t: Caseload) -> DataFrame:
    return ev.forged_tag_audit(t.texts(), "content", "source")


@query
def envelope_detect(t: Caseload) -> DataFrame:
    return ev.enveloped_only(t.web_pages(), "content").select("page_id", F.length("content").cast("bigint").alias("n_chars"))


@query
def source_domain_reject(t: Caseload) -> DataFrame:
    return ev.rejected_sources(t.texts(), "source").select("doc_id", "source")


@query
def injection_scan(t: Caseload) -> DataFrame:
    return ev.injection_report(t.texts(), "content", "source")


@query
def phrase_screen(t: Caseload) -> DataFrame:
    return phrases.phrase_report(t.texts(), "content", "source", t.phrases())


@query
def mask_traces(t: Caseload) -> DataFrame:
    masked = ev.mask_texts(t.invoice_texts(), "text")
    return masked.select("case_id", "masked", "n_email", "n_iban", "n_vat_id", "n_phone")


# Transcripts


def _cases(t: Caseload) -> DataFrame:
    return t.table("documents").select(F.col("doc_id").alias("case_id"))


@query
def transcripts(t: Caseload) -> DataFrame:
    return tr.assemble_transcripts(t.transcript(), cases=_cases(t))


@query
def transcript_parts(t: Caseload) -> DataFrame:
    return tr.transcript_parts(t.transcript(), part_bytes=2048)


@query
def dispatch_rows(t: Caseload) -> DataFrame:
    return tr.dispatch_rows(t.dispatches(), t.dispatch_replies())


# Flow: vendor lookup, header fields, review


def _lookup_stage(t: Caseload) -> Stage:
    def run(cases: DataFrame) -> DataFrame:
        found = masterdata.enrich_vendors(cases, t.vendors())
        return found.withColumn("data", F.struct("vendor_id", "found", F.col("vendor").alias("record")))

    return Stage("stammdaten", run)


def _fields_stage(cases: DataFrame) -> DataFrame:
    found = extraction.extract_fields(cases, "task", {"tax_id": extraction.HEADER_FIELDS["tax_id"]})
    summary = F.concat(F.lit("Not found: "), F.array_join("low_confidence", ","))
    return found.withColumns({"summary": summary, "data": F.struct("tax_id", "low_confidence")})


def _review_stage(cases: DataFrame) -> DataFrame:
    composed = compose_task("task", "prior")
    return cases.withColumn("summary", F.concat(F.lit("Reviewed "), F.length(composed).cast("string"), F.lit(" characters")))


def _flow(t: Caseload) -> CaseFlow:
    return CaseFlow([_lookup_stage(t), Stage("fields", _fields_stage), Stage("review", _review_stage)])


@query
def prior_context(t: Caseload) -> DataFrame:
    return row_priors(_flow(t).run(t.cases()))


@query
def prior_context_log(t: Caseload) -> DataFrame:
    """The same from the output log, where a case is several rows."""
    return prior_contexts(output_rows(_flow(t).run(t.cases())))


@query
def output_log(t: Caseload) -> DataFrame:
    """Outputs of two flows in one long table: a lookup and then a review of every case."""
    looked_up = output_rows(CaseFlow([_lookup_stage(t)]).run(t.cases()))
    reviewed = output_rows(CaseFlow([Stage("review", _review_stage)]).run(t.cases()))
    later = reviewed.withColumn("step", F.col("step") + 1)
    return append_outputs(looked_up, later).select("case_id", "step", "name", "summary")


@query
def composed_task(t: Caseload) -> DataFrame:
    """Lookup, then the task a following stage would get."""
    looked_up = CaseFlow([_lookup_stage(t)]).run(t.cases())
    return looked_up.select("case_id", compose_task("task", "prior").alias("composed_task"))


@query
def final_summary(t: Caseload) -> DataFrame:
    """The outcome of every order's case; most orders had no letter that a flow could handle."""
    orders = t.table("orders").select(F.col("o_orderkey").alias("case_id"))
    return final_summaries(orders, output_rows(_flow(t).run(t.cases())))


def _letters_of_others(cases: DataFrame) -> DataFrame:
    """A stage that breaks the contract: it leaves cases out."""
    return cases.where("lang <> 'fr'").withColumn("summary", F.lit("kept"))


@query
def stage_contract(t: Caseload) -> DataFrame:
    """Cases before and after each stage, counted in the run itself."""
    watch = Watch()
    flow = CaseFlow([Stage("fields", _fields_stage), Stage("others", _letters_of_others), Stage("review", _review_stage)])
    flow.run(t.cases(), watch).write.format("noop").mode("overwrite").save()
    return watch.report(t.spark)


# Master data


@query
def vendor_enrich(t: Caseload) -> DataFrame:
    found = masterdata.enrich_vendors(t.cases(), t.vendors())
    return found.select("case_id", "vendor_id", "found", "summary", F.col("vendor.name").alias("name"), "vendor.is_blocked")


@query
def vendor_enrich_salted(t: Caseload) -> DataFrame:
    """The same lookup by shuffle, as for a vendor table too large to broadcast."""
    found = masterdata.enrich_vendors(t.cases(), t.vendors(), broadcast_rows=0)
    return found.select("case_id", "vendor_id", "found", "summary", F.col("vendor.name").alias("name"), "vendor.is_blocked")


@query
def vendor_quality(t: Caseload) -> DataFrame:
    fields = ["name", "iban", "country", "payment_terms"]
    return masterdata.record_quality(t.vendor_ages(), fields, "changed_on", _day("2001-12-01"), 60)


@query
def vendor_flags(t: Caseload) -> DataFrame:
    fields = ["name", "iban", "country", "payment_terms"]
    flagged = masterdata.flag_records(t.vendor_ages(), fields, "changed_on", _day("2001-12-01"), 60)
    return flagged.select("vendor_id", "null_fields", "is_stale")


@query
def id_consistency(t: Caseload) -> DataFrame:
    return masterdata.id_consistency(t.mentions(), "case_id", "text")


# Ledgers


@query
def ledger_parse(t: Caseload) -> DataFrame:
    return rp.parse_replies(t.progress_replies(), "raw", rp.PROGRESS).drop("raw")


def _task_ledgers(t: Caseload, kind: rp.ReplyKind) -> DataFrame:
    parsed = rp.parse_replies(t.ledger_replies(), "raw", kind).drop("raw")
    return parsed.withColumns({c: F.array_join(c, "|") for c in ("facts", "guesses", "plan")})


@query
def first_ledger_parse(t: Caseload) -> DataFrame:
    return _task_ledgers(t, rp.FIRST_LEDGER)


@query
def next_ledger_parse(t: Caseload) -> DataFrame:
    return _task_ledgers(t, rp.NEXT_LEDGER)


def _ledgers(t: Caseload) -> DataFrame:
    """Accepted ledgers; the log position serves as revision."""
    parsed = rp.accepted(rp.parse_replies(t.ledger_replies(), "raw", rp.FIRST_LEDGER))
    return parsed.select("case_id", F.col("seq").alias("revision"), "facts", "guesses", "plan")


@query
def ledger_quarantine(t: Caseload) -> DataFrame:
    refused = rp.quarantined(rp.parse_replies(t.progress_replies(), "raw", rp.PROGRESS), rp.PROGRESS)
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n_replies"))


@query
def plan_steps(t: Caseload) -> DataFrame:
    return ledgers.plan_steps(_ledgers(t), registry.registry_view(t.worker_log()))


@query
def plan_workers(t: Caseload) -> DataFrame:
    steps = ledgers.plan_steps(_ledgers(t), registry.registry_view(t.worker_log()))
    return ledgers.steps_per_worker(steps)


def _delta(t: Caseload, **bounds) -> DataFrame:
    replies = t.ledger_replies().select("case_id", F.col("seq").alias("revision"))
    delta = ledgers.revision_delta(_ledgers(t), counts_from=replies, **bounds)
    return delta.select(
        "case_id", "revision", *[F.array_join(c, "|").alias(c) for c in ("learned", "dropped", "repeated_steps")]
    )


@query
def facts_delta(t: Caseload) -> DataFrame:
    return _delta(t)


@query
def facts_delta_chunked(t: Caseload) -> DataFrame:
    return _delta(t, rows_per_chunk=16)


@query
def replan_inputs(t: Caseload) -> DataFrame:
    cases = t.table("customer").select(F.col("c_custkey").alias("case_id"))
    return ledgers.replan_inputs(cases, _ledgers(t))


# Loop replay


def _known_steps(t: Caseload) -> DataFrame:
    return registry.with_known_worker(t.steps(), registry.registry_view(t.worker_log()))


def _trace(t: Caseload, steps: DataFrame, **bounds) -> DataFrame:
    return replay.replay_trace(steps, counts_from=t.steps(), **bounds)


@query
def replay_trace(t: Caseload) -> DataFrame:
    return _trace(t, _known_steps(t))


@query
def replay_trace_chunked(t: Caseload) -> DataFrame:
    """The same trace with every case treated as hot."""
    return _trace(t, _known_steps(t), rows_per_chunk=16)


@query
def replay_summary(t: Caseload) -> DataFrame:
    return replay.replay_summary(_trace(t, _known_steps(t)))


def _closing(t: Caseload, cases: DataFrame, texts: DataFrame) -> DataFrame:
    """``case_id, final_answer`` with the request that closes a case: its task and its transcript."""
    told = cases.join(t.cases().select("case_id", "task"), "case_id", "left").join(
        texts.select("case_id", "transcript"), "case_id", "left"
    )
    task = F.coalesce("task", F.concat(F.lit("case "), F.col("case_id").cast("string")))
    values = {"task": task, "transcript": F.coalesce("transcript", F.lit(tr.EMPTY))}
    asked = prompts.supervisor_requests(told, prompts.render(prompts.FINAL_TEMPLATE, values), DEFAULT_MODEL)
    return asked.select("case_id", "final_answer", "model_id", "messages")


@query
def run_summary(t: Caseload) -> DataFrame:
    """What a run returns; the payload of the steps goes through the replay's one shuffle."""
    trace = _trace(t, _known_steps(t), payload=("next_speaker", "instruction", "reply", "final_answer"))
    sent = trace.where(replay.with_instruction(F.col("route"), F.col("instruction")))
    texts = tr.assemble_transcripts(tr.step_rows(sent))
    ended = trace.where(F.col("route").startswith("finalize")).select("case_id", "final_answer")
    answers = scoring.final_answers(_closing(t, ended, texts), stub_model)
    ran = replay.run_summary(replay.replay_summary(trace), answers, texts, ledgers.latest_ledgers(_ledgers(t)))
    return ran.select(
        *[c for c in ran.columns if c != "task_ledger"],
        "task_ledger.revision",
        *[F.array_join(f"task_ledger.{c}", "|").alias(c) for c in ("facts", "plan")],
    )


@query
def stall_runs(t: Caseload) -> DataFrame:
    return replay.stall_runs(t.steps())


@query
def stall_runs_chunked(t: Caseload) -> DataFrame:
    return replay.stall_runs(t.steps(), rows_per_chunk=16)


@query
def loop_detect(t: Caseload) -> DataFrame:
    return replay.repeated_steps(t.steps())


@query
def loop_detect_chunked(t: Caseload) -> DataFrame:
    return replay.repeated_steps(t.steps(), rows_per_chunk=16)


# Workers, models, prompts


@query
def registry_view(t: Caseload) -> DataFrame:
    return registry.registry_view(t.catalogue_log())


@query
def manifest(t: Caseload) -> DataFrame:
    return registry.manifest(registry.registry_view(t.catalogue_log()))


@query
def known_workers(t: Caseload) -> DataFrame:
    view = registry.registry_view(t.worker_log())
    return registry.known_workers(t.steps(), view).select("case_id", "seq", "next_speaker")


@query
def unknown_workers(t: Caseload) -> DataFrame:
    view = registry.registry_view(t.worker_log())
    return registry.unknown_workers(t.steps(), view).select("case_id", "seq", "next_speaker")


@query
def unknown_worker_report(t: Caseload) -> DataFrame:
    return registry.unknown_worker_report(t.steps(), registry.registry_view(t.worker_log()))


@query
def routing_view(t: Caseload) -> DataFrame:
    """Every part routes its type to its brand; the last part of a type decides."""
    log = t.table("part").select(
        F.col("p_partkey").alias("reg_seq"), F.col("p_type").alias("role"), F.col("p_brand").alias("model_id")
    )
    return registry.routing_view(log)


@query
def model_assignment(t: Caseload) -> DataFrame:
    return registry.assign_models(t.calls(), t.routing(), DEFAULT_MODEL)


@query
def model_usage(t: Caseload) -> DataFrame:
    return registry.model_usage(registry.assign_models(t.calls(), t.routing(), DEFAULT_MODEL))


def _requests(t: Caseload) -> DataFrame:
    view = registry.registry_view(t.worker_log())
    return prompts.worker_requests(t.dispatches(), view, t.routing(), DEFAULT_MODEL)


@query
def requests(t: Caseload) -> DataFrame:
    return _requests(t).select(
        "case_id", "step", "model_id",
        F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"),
    )


@query
def render_prompts(t: Caseload) -> DataFrame:
    """The progress prompt of every case: latest plan, manifest, transcript."""
    plans = ledgers.replan_inputs(t.cases(), _ledgers(t)).select("case_id", "current_plan")
    texts = tr.assemble_transcripts(t.transcript(), cases=t.cases()).select("case_id", "transcript")
    values = {
        "task": F.col("task"),
        "worker_manifest": registry.manifest_text(registry.registry_view(t.worker_log())),
        "plan": F.col("current_plan"),
        "transcript": F.col("transcript"),
    }
    joined = t.cases().join(plans, "case_id").join(texts, "case_id")
    return joined.select("case_id", prompts.render(prompts.PROGRESS_TEMPLATE, values).alias("prompt"))


@query
def start_prompts(t: Caseload) -> DataFrame:
    """The request that opens every case, with the manifest of a long registration log."""
    values = {
        "task": F.col("task"),
        "worker_manifest": registry.manifest_text(registry.registry_view(t.catalogue_log())),
    }
    asked = prompts.supervisor_requests(t.cases(), prompts.render(prompts.START_TEMPLATE, values), DEFAULT_MODEL)
    return asked.select(
        "case_id", "model_id",
        F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"),
    )


@query
def replan_prompts(t: Caseload) -> DataFrame:
    """The prompt that asks for a new plan, for every customer's case."""
    cases = t.table("customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("task"))
    inputs = ledgers.replan_inputs(cases, _ledgers(t))
    texts = tr.assemble_transcripts(t.transcript(), cases=cases).select("case_id", "transcript")
    values = {
        "task": F.col("task"),
        "worker_manifest": registry.manifest_text(registry.registry_view(t.worker_log())),
        "current_facts": F.col("current_facts"),
        "current_plan": F.col("current_plan"),
        "transcript": F.col("transcript"),
    }
    joined = cases.join(inputs, "case_id").join(texts, "case_id")
    return joined.select("case_id", "next_revision", prompts.render(prompts.REPLAN_TEMPLATE, values).alias("prompt"))


@query
def batch_score(t: Caseload) -> DataFrame:
    scored = scoring.score(_requests(t), stub_model)
    return scored.select("case_id", "step", "model_id", "reply", "error")


@query
def batch_score_once(t: Caseload) -> DataFrame:
    """The same through a ledger of replies, so that nothing is asked twice."""
    scored = scoring.score_once(_requests(t), stub_model, run_dir(t.spark, "replies"))
    return scored.select("case_id", "step", "model_id", "reply", "error")


@query
def final_answers(t: Caseload) -> DataFrame:
    """Cases that end with a user's question have no answer yet and go to the model."""
    spoke_last = F.col("final_answer").endswith("(by user)")
    cases = t.answers().select("case_id", F.when(~spoke_last, F.col("final_answer")).alias("final_answer"))
    asked = cases.where(F.col("final_answer").isNull()).select("case_id")
    texts = tr.assemble_transcripts(t.transcript().join(asked, "case_id", "left_semi"))
    return scoring.final_answers(_closing(t, cases, texts), stub_model).select("case_id", "final_answer", "origin")


@query
def attribution(t: Caseload) -> DataFrame:
    said = t.table("conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("speaker"))
    return prompts.attribution(t.answers(), said)


# Reconciliation


@query
def po_invoice_recon(t: Caseload) -> DataFrame:
    return reconcile.reconcile_orders(t.order_lines(), t.invoice_lines())


@query
def recon_totals(t: Caseload) -> DataFrame:
    matched = reconcile.reconcile_orders(t.order_lines(), t.invoice_lines(), tolerance_cents=500_000)
    return reconcile.status_totals(matched, "po_cents", "invoice_cents")


@query
def delivery_recon(t: Caseload) -> DataFrame:
    return reconcile.reconcile_deliveries(t.delivery_lines(), t.invoice_lines())


@query
def dunning(t: Caseload) -> DataFrame:
    aged = reconcile.age_open_items(t.open_items(), _day("1998-01-01"), DUNNING_LEVELS)
    return aged.select("item", "days_overdue", "dunning_level", "escalate")


@query
def dunning_by_customer(t: Caseload) -> DataFrame:
    """Levels from a table: per customer and by the day an item fell due."""
    aged = reconcile.age_open_items_by(t.customer_items(), t.dunning_levels(), _day("1998-01-01"))
    return aged.select("item", "customer", "days_overdue", "dunning_level", "escalate")


@query
def booking_codes(t: Caseload) -> DataFrame:
    return reconcile.map_bookings(t.postings(), t.chart())


@query
def booking_rejects(t: Caseload) -> DataFrame:
    return reconcile.bookings_outside_chart(t.postings(), t.chart())


@query
def field_extract(t: Caseload) -> DataFrame:
    found = extraction.extract_fields(t.invoice_texts(), "text")
    return found.drop("text").withColumn("low_confidence", F.array_join("low_confidence", ","))


# Evaluation and history


@query
def field_accuracy(t: Caseload) -> DataFrame:
    return evals.field_accuracy(t.predictions(), t.table("labels"), "doc_id", "lang", ["quality", "toxic"])


@query
def kpis(t: Caseload) -> DataFrame:
    return evals.workflow_rates(t.handled_cases(), ["workflow", "day"])


@query
def attr_history(t: Caseload) -> DataFrame:
    return history.change_intervals(t.table("events"), "user_id", "event_id", "event_type")


@query
def attr_history_chunked(t: Caseload) -> DataFrame:
    return history.change_intervals(t.table("events"), "user_id", "event_id", "event_type", rows_per_chunk=16)


def _probes(t: Caseload) -> DataFrame:
    return t.table("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status")
    )


@query
def attr_as_of(t: Caseload) -> DataFrame:
    return history.value_as_of(t.table("events"), _probes(t), "user_id", "event_id", "event_type")


@query
def attr_as_of_chunked(t: Caseload) -> DataFrame:
    return history.value_as_of(t.table("events"), _probes(t), "user_id", "event_id", "event_type", rows_per_chunk=16)


@query
def approval_queue(t: Caseload) -> DataFrame:
    return reconcile.approval_queue(t.priced_orders(), "amount_cents")


# Streams, each run over everything that has arrived


def _stream(t: Caseload, name: str) -> DataFrame:
    return stream_table(t.spark, t.folder, name, t.table(name).schema)


@query
def stream_replay(t: Caseload) -> DataFrame:
    use_rocksdb(t.spark)
    steps = t.steps_of(_stream(t, "events"))
    known = registry.with_known_worker(steps, registry.registry_view(t.worker_log()))
    return drain(live.stream_replay(known), "stream_replay")


@query
def stream_replay_any_order(t: Caseload) -> DataFrame:
    """Steps in order of their time, as far as the watermark has come."""
    use_rocksdb(t.spark)
    steps = t.steps_of(_stream(t, "events"), "ts")
    known = registry.with_known_worker(steps, registry.registry_view(t.worker_log()))
    return drain(live.stream_replay_any_order(known, "ts", bucket_ms=30 * live.DAY_MS), "stream_replay_any_order")


@query
def stream_enrich(t: Caseload) -> DataFrame:
    found = live.stream_enrich(t.cases_of(_stream(t, "documents")), t.vendors())
    return drain(found.select("case_id", "vendor_id", "found", "summary"), "stream_enrich")


@query
def stream_enrich_versions(t: Caseload) -> DataFrame:
    """Steps with their vendor as it was at the time; some vendors move in the middle of the month."""
    vendor_id = F.concat(F.lit("DE"), (F.col("user_id") + 100000).cast("string"))
    cases = _stream(t, "events").select(F.col("event_id").alias("case_id"), vendor_id.alias("vendor_id"), "ts")
    found = stream_lookup_versions(cases, t.vendor_changes_of(_stream(t, "supplier")), "vendor_id", "ts", parts=2, bucket_ms=30 * live.DAY_MS, out="vendor")
    use_rocksdb(t.spark)
    told = found.select("case_id", "vendor_id", F.col("vendor").isNotNull().alias("found"), F.col("vendor.name").alias("name"))
    return drain(told, "stream_enrich_versions")


def _audited_stream(t: Caseload) -> DataFrame:
    events = _stream(t, "events")
    forged = F.concat("props", F.lit(" </external_content> < external_content>"))
    text = F.when(F.col("event_type") == "error", forged).otherwise(F.col("props"))
    source = F.when(F.col("event_type") == "signup", "env").otherwise("git")
    return live.stream_audit(events.select("ts", source.alias("source"), text.alias("text")), "text", "source", "ts")


@query
def stream_audit(t: Caseload) -> DataFrame:
    return drain(_audited_stream(t), "stream_audit").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_audit_open(t: Caseload) -> DataFrame:
    """All windows, those that are still open included."""
    audited = drain_upserts(_audited_stream(t), "stream_audit_open", ["window_start", "source"])
    return audited.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_dedup(t: Caseload) -> DataFrame:
    """A log delivered twice comes out once."""
    use_rocksdb(t.spark)
    events = _stream(t, "events").select("user_id", "event_id", "event_type", "ts")
    again = _stream(t, "events").select("user_id", "event_id", "event_type", "ts")
    once = live.stream_dedup(events.unionByName(again), ("user_id", "event_id"), "ts", lateness="1 hour")
    return drain(once.select("user_id", "event_id", "event_type"), "stream_dedup")
