"""What a claim's files say: counters, last papers, entities, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions import extract as E
from tallygrain.functions.identity import with_identity
from tallygrain.functions.text import document_role, indian_digits, is_hindi, let, word_hits
from tallygrain.operators.spread import first_per_key


def classify(texts: DataFrame, text: str = "text", filename: str | None = None) -> DataFrame:
    name = F.col(filename) if filename else F.lit("")
    roles = texts.withColumn("_r", document_role(F.col(text), name))
    return roles.select(*texts.columns, "_r.*")


def join_pages(pages: DataFrame) -> DataFrame:
    """Page texts of a file as one text; empty pages are skipped, numbers stay."""
    page = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    return (
        pages.groupBy("file_id")
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.trim("text") != "", F.struct("page", page.alias("text"))))
            ).alias("p")
        )
        .select("file_id", F.trim(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text"))
        .withColumn("hindi", is_hindi(F.col("text")))
    )


def exif_counters(evidence: DataFrame) -> DataFrame:
    photo = F.col("kind") == "photo"
    edited = photo & (F.coalesce(F.col("exif.software"), F.lit("")) != "")
    return evidence.groupBy("claim_id").agg(
        F.count_if(photo).alias("n_photos"),
        F.count_if(photo & ~F.coalesce(F.col("exif.present"), F.lit(False))).alias("n_no_exif"),
        F.count_if(edited).alias("n_edited"),
        F.count_if(photo & F.col("exif.gps").isNotNull()).alias("n_geotagged"),
    )


def first_photos(images: DataFrame, n: int) -> DataFrame:
    """First ``n`` photos of each claim, in evidence order."""
    photos = images.where(F.col("kind") == "photo")
    return first_per_key(photos, ["claim_id"], [F.col("seq"), F.col("file_id")], n, "rank")


def last_papers(evidence: DataFrame, ocr: DataFrame) -> DataFrame:
    """File that counts per claim and kind: the last readable one.

    Columns: claim_id, kind, n_files, last_file_id (null when none is readable),
    first_file_id.
    """
    order = F.struct("seq", "file_id")
    readable = F.length(F.coalesce("text", F.lit(""))) > 0
    return (
        evidence.join(ocr.select("file_id", "text").hint("merge"), "file_id", "left")
        .groupBy("claim_id", "kind")
        .agg(
            F.count("*").alias("n_files"),
            F.max(F.when(readable, order)).alias("last"),
            F.min(order).alias("first"),
        )
        .select(
            "claim_id",
            "kind",
            "n_files",
            F.col("last.file_id").alias("last_file_id"),
            F.col("first.file_id").alias("first_file_id"),
        )
    )


def claim_features(evidence: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row per claim with everything the stages need from its files.

    Files meet their text once; each text is parsed where it is read, and only
    the small structs go into the one aggregation by claim.
    """
    # merge: by the packed size of its files Spark would take the texts for few enough to send to the driver
    files = evidence.join(ocr.select("file_id", "text", "hindi").hint("merge"), "file_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    kind, text, read = F.col("kind"), F.col("text"), F.length("text") > 0
    order = F.struct("seq", "file_id")
    photo = kind == "photo"
    shows = let(
        F.lower(text),
        lambda t: F.struct(*[(word_hits(t, C.LOSS_META[loss]["terms"]) > 0).alias(loss) for loss in C.LOSS_TYPES]),
    )
    parsed = files.select(
        "claim_id",
        "kind",
        order.alias("ord"),
        read.alias("read"),
        F.length("text").alias("chars"),
        F.coalesce("hindi", F.lit(False)).alias("hindi"),
        "exif",
        F.when(kind.isin("bill", "id") & read, E.bill(text)).alias("bill"),
        F.when((kind == "aadhaar") & read, E.identity_card(text)).alias("card"),
        F.when((kind == "registry") & read, E.land_record(text)).alias("deed"),
        F.when((kind == "policy") & read, E.policy_paper(text)).alias("paper"),
        F.when(kind == "registry", text).alias("deed_text"),
        F.when(kind.isin(*C.FARMER_DOCS) & read, document_role(text, F.col("filename"))["role"]).alias("role"),
        F.when(photo, shows).alias("shows"),
    )
    photo, read = F.col("kind") == "photo", F.col("read")
    software = F.col("exif.software")
    edited = photo & (F.coalesce(software, F.lit("")) != "")

    def last(value: str, only: Column | None = None) -> Column:
        chosen = F.col(value).isNotNull() if only is None else only
        return F.max_by(F.when(chosen, F.col(value)), F.when(chosen, F.col("ord"))).alias(value)

    doc = F.struct("hindi", "chars", "role", "read")
    per_kind = []
    for name in C.FARMER_DOCS:
        mine = F.col("kind") == name
        per_kind += [
            F.count_if(mine).alias(f"n_{name}"),
            F.count_if(mine & ~read).alias(f"unread_{name}"),
            F.min(F.when(mine & ~read, F.col("ord"))).alias(f"first_unread_{name}"),
            F.max_by(F.when(mine, doc), F.when(mine, F.col("ord"))).alias(f"doc_{name}"),
        ]
    return parsed.groupBy("claim_id").agg(
        F.count_if(photo).alias("n_photos"),
        F.count_if(photo & ~F.coalesce(F.col("exif.present"), F.lit(False))).alias("n_no_exif"),
        F.count_if(edited).alias("n_edited"),
        # an accepted claim holds a few photos (see validate)
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(edited, F.struct("ord", software.alias("tag"))))), lambda x: x["tag"]), ", "
        ).alias("software"),
        F.count_if(photo & F.col("exif.gps").isNotNull()).alias("n_geotagged"),
        F.count_if(~photo).alias("n_docs"),
        # farmer papers are read by another pass and never count here
        F.count_if(F.col("kind").isin("bill", "id", "satellite") & read).alias("n_docs_read"),
        *[F.count_if(F.col(f"shows.{loss}")).alias(f"shows_{loss}") for loss in C.LOSS_TYPES],
        last("bill"),
        last("card"),
        last("deed"),
        last("paper"),
        last("deed_text", F.col("kind") == "registry"),
        F.count_if(F.col("kind") == "satellite").alias("n_satellite"),
        *per_kind,
    )


def with_cross_check(features: DataFrame) -> DataFrame:
    """Add ``identity`` where a claim has a readable card and land record."""
    both = F.col("card").isNotNull() & (F.length("deed_text") > 0)
    ready = (
        features.withColumn("_holder", F.when(both, F.col("card.name")))
        .withColumn("_holder_deva", F.when(both, F.col("card.name_devanagari")))
        .withColumn("_deed_text", F.when(both, F.col("deed_text")))
    )
    return (
        with_identity(ready, "_holder", "_holder_deva", "_deed_text")
        .withColumn("identity", F.when(both, F.col("identity")))
        .drop("_holder", "_holder_deva", "_deed_text", "deed_text")
    )


def _entity(doc_kind: str, label: str, value: Column, confidence: float) -> Column:
    return F.when(
        value.isNotNull() & (value.cast("string") != ""),
        F.struct(
            F.lit(doc_kind).alias("doc_kind"),
            F.lit(label).alias("label"),
            value.cast("string").alias("value"),
            F.lit(confidence).alias("confidence"),
        ),
    )


def _rupees(amount: Column) -> Column:
    return F.when(amount != 0, F.concat(F.lit("₹"), indian_digits(amount)))


def entities() -> Column:
    """Label, value and confidence of every field found (at most 14 per claim)."""
    found = [_entity("registry", label, F.col(f"deed.{f}"), c) for f, label, c in C.REGISTRY_ENTITIES]
    found += [_entity("aadhaar", label, F.col(f"card.{f}"), c) for f, label, c in C.AADHAAR_ENTITIES]
    has_paper = F.col("paper").isNotNull()
    for f, label, c in C.POLICY_ENTITIES:
        value = _rupees(F.col(f"paper.{f}")) if f == "sum_insured" else F.col(f"paper.{f}")
        found.append(F.when(has_paper, _entity("policy", label, value, c)))
    for f, doc_kind, label, c in C.BILL_ENTITIES:
        value = _rupees(F.col(f"bill.{f}")) if f == "amount" else F.col(f"bill.{f}")
        found.append(F.when(~has_paper, _entity(doc_kind, label, value, c)))
    return F.array_compact(F.array(*found))


def entity_rows(features: DataFrame) -> DataFrame:
    return features.select("claim_id", F.explode(entities()).alias("e")).select("claim_id", "e.*")


def entities_by_kind(rows: DataFrame) -> DataFrame:
    """Entities of each (claim, document kind) for display."""
    return rows.groupBy("claim_id", "doc_kind").agg(
        F.count("*").alias("n"),
        # a claim yields at most six entities of a kind
        F.array_sort(F.collect_list(F.struct("label", "value", "confidence"))).alias("entities"),
    )


def document_summary() -> Column:
    """Nested summary of a claim's papers; expects features, satellite and claim columns."""
    deed, card, paper, bill = (F.col(c) for c in ("deed", "card", "paper", "bill"))
    identity = F.col("identity")
    none = F.lit(None).cast("string")
    measured = F.col("satellite_pct")
    return F.struct(
        F.struct(
            (F.col("n_registry") > 0).alias("found"),
            deed["deed_type"].alias("deed_type"),
            deed["district"].alias("district"),
            deed["village"].alias("village"),
            deed["execution_date"].alias("execution_date"),
            deed["khasra_no"].alias("khasra_no"),
            deed["area_hectares"].alias("area_hectares"),
            deed["state"].alias("state"),
            F.when(
                F.col("n_registry") > 0, F.when(F.col("doc_registry.hindi"), "hindi").otherwise("english")
            ).alias("language"),
        ).alias("registry"),
        F.struct(
            (F.col("n_aadhaar") > 0).alias("found"),
            card["name"].alias("name"),
            card["name_devanagari"].alias("name_devanagari"),
            card["aadhaar_masked"].alias("aadhaar_masked"),
            card["dob"].alias("dob"),
            card["gender"].alias("gender"),
        ).alias("aadhaar"),
        F.struct(
            F.coalesce(identity["matched"], F.lit(False)).alias("matched"),
            F.coalesce(identity["score"], F.lit(0)).alias("score"),
            F.coalesce(
                identity["detail"], F.lit("no cross-check performed (missing registry or Aadhaar)")
            ).alias("detail"),
            F.coalesce(identity["inconclusive"], F.lit(True)).alias("inconclusive"),
            identity["aadhaar_name"].alias("aadhaar_name"),
            identity["registry_name"].alias("registry_name"),
            identity["transliterated"].alias("transliterated"),
        ).alias("identity_cross"),
        F.struct(
            (paper.isNotNull() | bill["policy_number"].isNotNull()).alias("found"),
            F.coalesce(paper["policy_number"], bill["policy_number"]).alias("policy_number"),
            F.coalesce(paper["sum_insured"], bill["amount"].cast("double")).alias("sum_insured"),
            paper["coverage"].alias("coverage"),
            F.coalesce(paper["insured_name"], bill["name"]).alias("insured_name"),
        ).alias("policy"),
        F.struct(
            measured.isNotNull().alias("found"),
            measured.alias("destruction_pct"),
            F.coalesce(F.col("satellite_rung"), none).alias("rung"),
        ).alias("satellite"),
        F.col("destruction_pct_claimed").alias("claimed_pct"),
        F.abs(F.col("destruction_pct_claimed") - measured).alias("pct_delta"),
        entities().alias("entities"),
    )


def evidence_list(evidence: DataFrame) -> DataFrame:
    """All files of all kinds in the order they are listed, with their place."""
    rank = F.array_position(F.array(*[F.lit(k) for k in C.KIND_ORDER]), F.col("kind")).cast("int")
    return evidence.withColumn("kind_rank", rank).select(
        "claim_id", "kind_rank", "seq", "file_id", "kind", "sha256", "p_hash"
    )


def text_snippets(evidence: DataFrame, ocr: DataFrame) -> DataFrame:
    """Start of every text read, shorter for plain files than for farmer papers."""
    files = evidence.join(ocr.where(F.length("text") > 0).select("file_id", "text").hint("merge"), "file_id")
    limit = F.when(F.col("kind").isin(*C.FARMER_DOCS), 2000).otherwise(1500)
    return files.select("claim_id", "file_id", "kind", F.substring("text", F.lit(1), limit).alias("snippet"))
