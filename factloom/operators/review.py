"""Review and catalog: tasks, decisions, approved diffs as versions; set-based, each step a table to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from factloom.functions.records import full
from factloom.functions.scalars import clamp, cluster_key, host_of, let, lookup
from factloom.operators.policy import signal_cluster, validate
from factloom.operators.resolve import identities, match_action, match_score, pair_signals, resolve_identity
from factloom.sources.store import absent
from factloom.sources.tables import dealt

# Severity of a failure; members of a payload; raw keys that fill an empty core field, first ones first.
FAILURE_SEVERITY = {"fetch_failed": "high", "captcha_wall": "high", "no_data_extracted": "high", "artifact_duplicate": "low"}
PAYLOAD_TEXTS = ["title", "brand", "gtin", "gtinType", "modelNumber", "manufacturerPartNumber", "description", "currency", "canonicalCategory", "categorySchemaVersion"]
PAYLOAD_NUMBERS = ["basePrice", "weightGrams", "categoryConfidence"]
REFILL = {
    "title": ["title"], "brand": ["brand", "vendor"], "gtin": ["gtin", "barcode"], "modelNumber": ["modelNumber", "model_number", "mpn"], "description": ["description"],
    "basePrice": ["basePrice", "base_price", "price"], "currency": ["currency"], "canonicalCategory": ["canonicalCategory", "productType", "category_path"],
}
APPROVABLE = ("open", "pending")
RUNGS = [
    ("dom_heuristic", "startswith", ["dom_heuristic:"]), ("vision_llm", "startswith", ["vision:"]), ("json_ld", "startswith", ["json_ld"]), ("nuxt", "startswith", ["nuxt:", "window.__NUXT__"]),
    ("opengraph", "startswith", ["og:", "opengraph"]), ("rdfa", "startswith", ["schema:", "rdfa:"]), ("per_site_parser:amazon", "contains", ["amazon"]), ("per_site_parser:ebay", "contains", ["ebay"]),
    ("per_site_parser:walmart", "contains", ["walmart"]), ("per_site_parser:bestbuy", "contains", ["bestbuy", ".specs-table", ".priceView"]), ("per_site_parser:croma", "contains", ["croma", ".pd-title"]),
]


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


# Evidence.


def new_facts(facts: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Facts whose key isn't stored, with confidences kept in 0 to 1."""
    return absent(facts, stored, keys).withColumn("confidence", clamp(F.col("confidence")))


def backfill(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions with attributes and evidence of extensions where they had none; and the counts, a row.

    versions: version, attributes, evidence (maps or null), extensions (struct of attributes, evidence, or null). A dry
    run is the counts alone: examined (no attributes), would_update (the extensions have some).
    """
    empty = lambda m: m.isNull() | (F.size(m) == 0)
    due = empty(F.col("attributes")) & ~empty(F.col("extensions.attributes"))
    counts = versions.agg(F.count_if(empty(F.col("attributes"))).alias("examined"), F.count_if(due).alias("would_update"))
    filled = versions.select("*", due.alias("_due")).withColumn("evidence", F.when(F.col("_due"), F.col("extensions.evidence")).otherwise(F.col("evidence")))
    return filled.withColumn("attributes", F.when(F.col("_due"), F.col("extensions.attributes")).otherwise(F.col("attributes"))).drop("_due"), counts


def audit_events(rows: DataFrame, event: str, entity: str, entity_id: str, actor: str, **metadata: str) -> DataFrame:
    """ts, tenant, actor_type, event_type, entity_type, entity_id, metadata (JSON) of rows (ts, tenant and the named columns)."""
    pairs = [F.col(c).alias(k) for k, c in metadata.items()]
    return rows.select("ts", "tenant", F.lit(actor).alias("actor_type"), F.lit(event).alias("event_type"), F.lit(entity).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), F.to_json(F.struct(*pairs)).alias("metadata"))


def ladder_events(facts: DataFrame) -> DataFrame:
    """An event for each fact: which rung gave which field of which domain."""
    return audit_events(facts, "ladder.rung_fired", "field", "raw_key", "worker", rung="rung", domain="domain", parserVersion="parser_version")


def selector_events(firings: DataFrame) -> DataFrame:
    """An event for each firing of a selector, successful or not."""
    return audit_events(firings, "selector.fired", "selector", "selector", "worker", domain="domain", success="success", parserVersion="parser_version")


def rung(pointer: Column, method: Column) -> Column:
    """Where a fact comes from, by the beginning of its pointer or what the pointer names; else its method."""
    p, out = F.coalesce(pointer, F.lit("")), None
    for name, how, marks in RUNGS:
        test = F.lit(False)
        for m in marks:
            test = test | (p.startswith(m) if how == "startswith" else p.contains(m))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(method)


# Tasks.


def review_tasks(detected: DataFrame, key: str = "product") -> DataFrame:
    """key, kind, severity, field, cluster_key, nth: a task for each signal of products (domain, category, brand)."""
    rows = detected.select(key, "domain", "category", "brand", F.posexplode("signals").alias("nth", "s"))
    dims = {"field": F.col("s.field"), "category": F.col("category"), "brand": F.col("brand")}
    return rows.select(key, F.col("s.kind").alias("kind"), F.col("s.severity").alias("severity"), F.col("s.field").alias("field"), signal_cluster(F.col("s.kind"), F.col("domain"), dims).alias("cluster_key"), "nth")


def failure_tasks(failures: DataFrame) -> DataFrame:
    """artifact, kind, severity, domain, cluster_key of failures (artifact, kind, url); an unknown kind is high."""
    domain = host_of(F.col("url"))
    return failures.select("artifact", "kind", F.coalesce(lookup(FAILURE_SEVERITY, F.col("kind")), F.lit("high")).alias("severity"), domain.alias("domain"), cluster_key({"signal_kind": F.col("kind"), "domain": domain}).alias("cluster_key"))


def normal_status(status: Column) -> Column:
    """A task's status; what is none of them is open."""
    return F.when(status.isin("in_progress", "resolved", "dismissed"), status).otherwise("open")


# Reading.


def of_tenant(rows: DataFrame, tenant: str, merchant: str | None = None) -> DataFrame:
    own = rows.filter(F.col("tenant") == tenant)
    return own if merchant is None else own.filter(F.col("merchant") == merchant)


def not_deleted(rows: DataFrame) -> DataFrame:
    """Rows of another status than deleted; a null status stays."""
    return rows.filter(~F.col("status").eqNullSafe("deleted"))


def page_after(rows: DataFrame, key: str, last, n: int) -> DataFrame:
    """The first n rows by key beyond `last` (None: from the beginning)."""
    return (rows if last is None else rows.filter(F.col(key) > last)).orderBy(key).limit(n)


def tasks_with_diffs(tasks: DataFrame, diffs: DataFrame, fields: DataFrame, artifacts: DataFrame) -> DataFrame:
    """tasks (task, diff_id, artifact) with diff, fields and artifact_row, nested; what a task lacks is null or empty."""
    nested = fields.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in fields.columns if c != "diff_id"]))).alias("fields"))
    d = diffs.select("diff_id", F.struct(*[c for c in diffs.columns if c != "diff_id"]).alias("diff"))
    a = artifacts.select("artifact", F.struct(*[c for c in artifacts.columns if c != "artifact"]).alias("artifact_row"))
    out = tasks.join(d, "diff_id", "left").join(nested, "diff_id", "left").join(a, "artifact", "left")
    return out.withColumn("fields", F.coalesce("fields", F.array().cast(nested.schema["fields"].dataType)))


def recent_artifacts(artifacts: DataFrame, runs: DataFrame, sets: DataFrame, facts: DataFrame) -> DataFrame:
    """artifacts with the latest run's extractor and the number of facts of its set, 0 without."""
    latest = runs.groupBy("artifact").agg(F.max_by(F.struct("run", "extractor"), F.struct("created_at", "run")).alias("r")).select("artifact", "r.run", "r.extractor")
    counts = facts.groupBy("fact_set").agg(F.count("*").alias("n"))
    one = sets.groupBy("run").agg(F.min("fact_set").alias("fact_set")).join(counts, "fact_set", "left").select("run", "n")
    return artifacts.join(latest, "artifact", "left").join(one, "run", "left").withColumn("fact_count", F.coalesce("n", F.lit(0))).drop("n")


def products_with_variants(products: DataFrame, versions: DataFrame, variants: DataFrame) -> DataFrame:
    """Products not deleted with the title and price of their current version and their variants, newest change first."""
    v = variants.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("variant_key", "sku", "price"))).alias("variants"))
    current = versions.select(F.col("version").alias("current_version"), "title", "price")
    out = not_deleted(products).join(current, "current_version", "left").join(v, "product", "left")
    return out.withColumn("variants", F.coalesce("variants", F.array().cast(v.schema["variants"].dataType))).orderBy(F.desc("updated_at"), "product")


def source_types(facts: DataFrame, by: str) -> DataFrame:
    """by, source_types: the distinct ones, sorted."""
    return facts.groupBy(by).agg(F.sort_array(F.collect_set("source_type")).alias("source_types"))


def calibration_rows(facts: DataFrame, sets: DataFrame, runs: DataFrame, artifacts: DataFrame, diffs: DataFrame, versions: DataFrame) -> DataFrame:
    """extractor, category, source_type, raw_confidence, outcome: facts of decided diffs; the category is the version's, if any.

    Outcome 1: the fact's diff was approved, 0: rejected; others don't say.
    """
    rows = facts.join(sets, "fact_set").join(runs, "run").join(artifacts, "artifact").join(diffs, "fact_set").filter(F.col("status").isin("approved", "auto_approved", "rejected"))
    rows = rows.join(versions.select("diff_id", "category"), "diff_id", "left")
    return rows.select("extractor", "category", "source_type", F.col("confidence").alias("raw_confidence"), (F.col("status") != "rejected").cast("int").alias("outcome"))


def profile_rows(runs: DataFrame, artifacts: DataFrame, sets: DataFrame, diffs: DataFrame) -> DataFrame:
    """url, extractor, confidence of each run: the confidence is its diff's, null where no set or no diff came of it."""
    rows = runs.join(artifacts.select("artifact", "url"), "artifact").join(sets, "run", "left").join(diffs.select("fact_set", F.col("confidence")), "fact_set", "left")
    return rows.select("run", "url", "extractor", "confidence")


def rolled_up(failures: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """failures with the grouped values (keys, id of the row that stays, first_seen, last_seen, occurrences) on that row."""
    g = grouped.select(F.col("id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("first_seen", "last_seen", "occurrences")])
    out = failures.join(g, "id", "left")
    return out.select(*keys, "id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("first_seen", "last_seen", "occurrences")])


# Payloads.


def payload(raw: Column) -> Column:
    """A diff's payload (JSON text) as a struct: members in camel or snake case, blank texts null, numbers or texts that
    are numbers, currencies in upper case, images with an address, attributes, variants with options."""
    names = [*PAYLOAD_TEXTS, *PAYLOAD_NUMBERS]
    both = [n for name in names for n in dict.fromkeys((name, snake(name)))]
    extra = """images array<struct<url:string,altText:string,alt_text:string>>, attributes map<string,string>, evidence map<string,string>,
    dimensionsCm struct<l:string,w:string,h:string>, dimensions_cm struct<l:string,w:string,h:string>,
    variants array<struct<sku:string,barcode:string,price:string,currency:string,inventoryQuantity:string,inventory_quantity:string,optionValues:map<string,string>,option_values:map<string,string>>>"""

    def of(x: Column) -> Column:
        pick = lambda v, name: v[name] if snake(name) == name else F.coalesce(v[name], v[snake(name)])
        finite = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
        texts = [(F.upper(full(pick(x, n))) if n == "currency" else full(pick(x, n))).alias(n) for n in PAYLOAD_TEXTS]
        numbers = [finite(pick(x, n)).alias(n) for n in PAYLOAD_NUMBERS]
        cm = F.coalesce(x["dimensionsCm"], x["dimensions_cm"])
        size = F.struct(*[finite(cm[d]).alias(d) for d in "lwh"])
        images = F.filter(F.transform(x["images"], lambda i: F.struct(full(i["url"]).alias("url"), full(F.coalesce(i["altText"], i["alt_text"])).alias("altText"))), lambda i: i["url"].isNotNull())
        options = lambda v: F.map_filter(F.coalesce(v["optionValues"], v["option_values"]), lambda k, o: full(o).isNotNull())
        variants = F.transform(x["variants"], lambda v: F.struct(full(v["sku"]).alias("sku"), full(v["barcode"]).alias("barcode"), finite(v["price"]).alias("price"), F.upper(full(v["currency"])).alias("currency"), finite(F.coalesce(v["inventoryQuantity"], v["inventory_quantity"])).alias("inventoryQuantity"), options(v).alias("optionValues")))
        none = lambda c, kind: F.coalesce(c, F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind))
        return F.struct(
            *texts, *numbers, F.when(F.coalesce(size["l"], size["w"], size["h"]).isNotNull(), size).alias("dimensionsCm"), F.coalesce(images, F.array().cast("array<struct<url:string,altText:string>>")).alias("images"),
            none(x["attributes"], "map<string,string>").alias("attributes"), none(x["evidence"], "map<string,string>").alias("evidence"), variants.alias("variants"),
        )

    return let(F.from_json(raw, ", ".join(f"`{n}` string" for n in both) + ", " + extra), of)


def refilled(diffs: DataFrame, facts: DataFrame) -> DataFrame:
    """diffs (fact_set, payload) whose empty core fields are those of the set's facts (fact_set, raw_key, value, ordinal):
    of each field's raw keys in turn the first value that isn't blank."""
    keys = {k: (field, i) for field, names in REFILL.items() for i, k in enumerate(names)}
    pairs = facts.filter(F.col("raw_key").isin(list(keys)) & full(F.col("value")).isNotNull())
    pairs = pairs.select("fact_set", lookup({k: f for k, (f, _) in keys.items()}, F.col("raw_key")).alias("field"), F.struct(lookup({k: i for k, (_, i) in keys.items()}, F.col("raw_key")).alias("i"), "ordinal").alias("at"), full(F.col("value")).alias("value"))
    # facts are dealt by set first, so that a task holds the sets of its part alone, not those of all that it reads
    wide = pairs.repartition("fact_set").groupBy("fact_set").agg(*[F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("at"))).alias(f"_{f}") for f in REFILL])
    p = F.col("payload")
    for f in REFILL:
        found = F.col(f"_{f}").try_cast("double") if f == "basePrice" else F.upper(f"_{f}") if f == "currency" else F.col(f"_{f}")
        p = p.withField(f, F.coalesce(F.col(f"payload.{f}"), found))
    return diffs.join(wide, "fact_set", "left").withColumn("payload", p).select(*diffs.columns)


# Applying.


def apply_diffs(diffs: DataFrame, versions: DataFrame, facts: DataFrame, rules: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """What approved diffs add to the catalog: versions, products, identities, tasks, errors, each a table to append.

    diffs: diff_id, fact_set, product (or null), status, payload (JSON text); versions: diff_id, product, gtin,
    modelNumber, title, brand, created_at; known: product, type, value of identities. A diff that has a version is
    left. A payload without a title, refilled, or against a strict schema, is an error (the latter a task too). A diff
    without a product gets that of its first known identity, or a new one named by the diff. Where the product's
    latest version is so unlike that it should be reviewed, a task says so; the version is appended all the same.
    The tables share what they are made from, which is kept in memory or on disk (persist) until the session ends or
    the caller clears the cache.
    """
    due = diffs.filter(F.col("status").isin("approved", "auto_approved")).join(versions.select("diff_id"), "diff_id", "left_anti")
    due = refilled(due.withColumn("payload", payload(F.col("payload"))).persist(), facts).persist()
    titled = due.filter("payload.title is not null")
    checked = validate(titled.select(F.col("diff_id").alias("id"), F.col("payload.canonicalCategory").alias("category"), "payload.attributes"), rules).withColumnRenamed("id", "diff_id").persist()
    fine = titled.join(checked.filter("valid").select("diff_id"), "diff_id", "left_semi")
    wrong = checked.filter("not valid")
    errors = due.filter("payload.title is null").select("diff_id", F.lit("no title").alias("error")).unionByName(wrong.select("diff_id", F.concat(F.lit("missing: "), F.array_join("missing", ", ")).alias("error")))
    asked = fine.select(F.col("diff_id").alias("product"), "payload.brand", "payload.gtin", F.col("payload.modelNumber").alias("mpn"), "payload.variants")
    own = identities(asked).persist()
    hit = resolve_identity(own, known).withColumnsRenamed({"candidate": "diff_id", "product": "_hit"})
    placed = fine.join(hit, "diff_id", "left").withColumn("_old", F.coalesce("product", "_hit")).withColumn("product", F.coalesce("_old", F.concat(F.lit("new:"), F.col("diff_id").cast("string")))).persist()
    latest = versions.groupBy("product").agg(F.max_by(F.struct("gtin", F.col("modelNumber").alias("mpn"), "title", "brand"), F.struct("created_at", "diff_id")).alias("v")).select("product", "v.*")
    both = placed.filter("_old is not null").select("diff_id", "product", "payload.gtin", F.col("payload.modelNumber").alias("mpn"), "payload.title", "payload.brand").alias("a").join(latest.alias("b"), "product")
    action = match_action(match_score(pair_signals("a", "b")))
    unlike = both.withColumn("_action", action).filter("_action = 'review'")
    tasks = wrong.select("diff_id", F.lit("schema_violation").alias("kind"), F.lit(None).cast("string").alias("cluster_key")).unionByName(unlike.select("diff_id", F.lit("value_conflict").alias("kind"), F.concat(F.lit("value_conflict:"), "product").alias("cluster_key")))
    new_versions = placed.select("diff_id", "product", "payload.*").drop("variants")
    products = placed.select("product", "diff_id", F.lit("active").alias("status"), F.col("payload.canonicalCategory").alias("category"), F.col("_old").isNull().alias("is_new"))
    named = own.withColumnRenamed("product", "diff_id").join(placed.select("diff_id", "product"), "diff_id").select("product", "type", "value")
    return {"versions": new_versions, "products": products, "identities": absent(named, known, ["type", "value"]), "tasks": tasks, "errors": errors}


# Decisions.


def cluster_decisions(clusters: DataFrame, tasks: DataFrame) -> DataFrame:
    """A decision for each open task of a cluster: clusters hold tenant, cluster_key, action and what goes with it.

    approve_all with a field is an edit of it; without one it does nothing to a task. reject_all rejects for wrong_value.
    """
    rest = [c for c in clusters.columns if c not in ("tenant", "cluster_key", "action")]
    rows = tasks.filter("status = 'open'").select("task", "tenant", "cluster_key").join(clusters, ["tenant", "cluster_key"])
    kind = F.when((F.col("action") == "approve_all") & F.col("field").isNotNull(), "edit").when(F.col("action") == "reject_all", "reject")
    return rows.withColumn("action", kind).filter("action is not null").select("task", "action", *rest).withColumn("reason", F.when(F.col("action") == "reject", "wrong_value"))


def decide(decisions: DataFrame, tasks: DataFrame, diffs: DataFrame, artifacts: DataFrame) -> dict[str, DataFrame]:
    """What decisions on tasks do: tables overrides, synonyms, diffs, failures, identities, tasks, to_apply.

    decisions: task, action (edit, reject, merge), field, value, canonical_key, reason, note, product, at; tasks: task,
    tenant, diff_id, status, field; diffs: diff_id, fact_set, status, payload (map of texts); artifacts: fact_set, url.

    edit: a canonical key makes an override for the domain, and a synonym to approve if it differs from the field; a
    value that isn't blank replaces the payload's. reject: a failure of (tenant, domain, reason) counts one more; the
    diff lives on. merge: the url becomes the product's identity, the diff is rejected. All resolve their task. A diff
    that is still open or pending, has no other open task and isn't merged away is to be applied, after all edits. Of
    several decisions on a task the last counts.

    Rows are dealt before they are grouped or joined, and no table is broadcast, so that a task holds its share of the
    rows and not what it reads. What the tables share is kept on disk (persist) until the session ends or the caller
    clears the cache.
    """
    last = dealt(decisions, "task").groupBy("task").agg(F.max_by(F.struct(*[c for c in decisions.columns if c != "task"]), "at").alias("d")).select("task", "d.*")
    urls = dealt(diffs.select("diff_id", "fact_set"), "fact_set").join(artifacts.hint("merge"), "fact_set", "left").select("diff_id", "url")
    asked = last.join(tasks.select("task", "tenant", "diff_id", F.col("field").alias("task_field")).hint("merge"), "task")
    known = dealt(asked, "diff_id").join(urls.hint("merge"), "diff_id", "left").withColumn("domain", host_of(F.col("url"))).persist(StorageLevel.DISK_ONLY)
    edits = known.filter("action = 'edit' and diff_id is not null")
    overrides = edits.filter("canonical_key is not null").select("tenant", F.nullif("domain", F.lit("")).alias("domain"), F.col("field").alias("raw_key"), "canonical_key", "task")
    synonyms = overrides.filter("raw_key <> canonical_key").select(F.col("raw_key").alias("synonym"), "canonical_key", F.lit("human_review").alias("source")).distinct()
    rejects = known.filter("action = 'reject'").withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")))
    failures = rejects.groupBy("tenant", "domain", "reason").agg(F.count("*").alias("occurrences"), F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("at", "task"))).alias("note"), F.min_by("task_field", F.struct("at", "task")).alias("raw_key"), F.max("at").alias("last_seen"))
    merges = known.filter("action = 'merge' and url is not null")
    aliases = dealt(merges.select("product", F.lit("url").alias("type"), F.col("url").alias("value")), "value").distinct()
    value = edits.filter(full(F.col("value")).isNotNull()).groupBy("diff_id", "field").agg(F.max_by("value", F.struct("at", "task")).alias("value"))
    patch = value.groupBy("diff_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("patch"))
    merged, touched = (F.col("action") == "merge") & F.col("url").isNotNull(), F.col("action").isin("edit", "reject")
    marks = known.groupBy("diff_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in (("merged", merged), ("touched", touched))])
    kept = F.map_filter("payload", lambda k, v: ~F.map_contains_key("patch", k))
    new_diffs = dealt(diffs, "diff_id").join(patch.hint("merge"), "diff_id", "left").join(marks.filter("merged").hint("merge"), "diff_id", "left")
    new_diffs = new_diffs.withColumn("payload", F.when(F.col("patch").isNull(), F.col("payload")).otherwise(F.map_concat(F.when(F.col("patch").isNull(), F.col("payload")).otherwise(kept), "patch")))
    new_diffs = new_diffs.withColumn("status", F.when(F.col("merged"), "rejected").otherwise(F.col("status"))).select(*diffs.columns)
    resolved = dealt(tasks, "task").join(last.select("task", F.col("note").alias("notes"), F.lit(True).alias("_done")).hint("merge"), "task", "left")
    resolved = resolved.withColumn("status", F.when(F.col("_done"), "resolved").otherwise(normal_status(F.col("status")))).drop("_done")
    still = resolved.filter("status = 'open'").select("diff_id").distinct()
    waiting = diffs.filter(F.col("status").isin(*APPROVABLE)).select("diff_id")
    to_apply = dealt(waiting, "diff_id").join(marks.filter("touched and not merged").hint("merge"), "diff_id", "left_semi").join(still.hint("merge"), "diff_id", "left_anti")
    return {"overrides": overrides, "synonyms": synonyms, "diffs": new_diffs, "failures": failures, "identities": aliases, "tasks": resolved, "to_apply": to_apply.select("diff_id")}


def with_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Failures (tenant, domain, reason, occurrences, note, raw_key, last_seen) with new ones counted in; a new note replaces the old."""
    keys = ["tenant", "domain", "reason"]
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*[c for c in stored.columns]).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("_new"))).alias("note"), F.min_by("raw_key", "_new").alias("raw_key"), F.max("last_seen").alias("last_seen"))
