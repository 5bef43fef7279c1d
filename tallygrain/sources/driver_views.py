"""Claim-shaped views over the benchmark tables (orders, lineitem, events, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrain import constants as C
from tallygrain.functions.digest import sha2_digest
from tallygrain.functions.numeric import tile_id
from tallygrain.operators.spread import dense_sequence

EVIDENCE_KINDS = ["photo", "bill", "id", "registry", "aadhaar", "satellite", "policy"]
FIRST_NAMES = ["Roshan", "Ramesh", "Sunita", "Devendra", "Vitthal", "Anita", "Kishor", "Meera"]
LAST_NAMES = ["Pandey", "Kumar", "Pawar", "Singh", "Rao", "Patil", "Shinde", "Joshi"]
FIRST_DEVA = ["रोशन", "रमेश", "सुनीता", "देवेन्द्र", "विट्ठल", "अनीता", "किशोर", "मीरा"]
LAST_DEVA = ["पांडेय", "कुमार", "पवार", "सिंह", "राव", "पाटिल", "शिंदे", "जोशी"]
EVENT_STATUS = {
    "signup": "SUBMITTED",
    "click": "AI_APPROVED",
    "view": "AI_FLAGGED",
    "purchase": "PAID",
    "error": "AI_REJECTED",
}
EVENT_REQUEST = {
    "signup": "HUMAN_REVIEW",
    "click": "HUMAN_APPROVED",
    "purchase": "PAID",
    "error": "HUMAN_REJECTED",
    "view": "AI_FLAGGED",
}
PLANTED = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_key(mapping: dict[str, str], key: Column) -> Column:
    out = None
    for name, value in mapping.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def person(k: Column) -> Column:
    return F.concat_ws(" ", _pick(FIRST_NAMES, k % 8), _pick(LAST_NAMES, F.floor(k / 8) % 8))


def person_deva(k: Column) -> Column:
    return F.concat_ws(" ", _pick(FIRST_DEVA, k % 8), _pick(LAST_DEVA, F.floor(k / 8) % 8))


def claim_id(k: Column) -> Column:
    return F.concat(F.lit("CLM-"), k.cast("string"))


def claims(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Claims from ``orders``, which may also be a stream of them."""
    k = F.col("o_orderkey")
    status = _pick(C.STATUSES, k % 10)
    decided = status != "SUBMITTED"
    duration = F.when(decided, 1000 + (k * 37) % 9000)
    submitted = F.col("o_orderdate").cast("timestamp")
    n_staff = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()
    verdict = (
        F.when(status.isin(*C.COMPUTED_VERDICTS), status)
        .when(status == "PAID", "AI_APPROVED")
        .when(status == "REJECTED", "AI_REJECTED")
        .when(decided, "AI_FLAGGED")
    )
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(names, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        claim_id(k).alias("id"),
        F.col("c_name").alias("claimant_name"),
        _pick(C.LOSS_TYPES, k % 3).alias("loss_type"),
        F.floor(F.col("o_totalprice") / 5).cast("int").alias("amount_requested"),
        status.alias("status"),
        F.when(k % 5 < 4, _pick([p[0] for p in C.POLICIES], k % 4)).alias("policy_number"),
        F.when(k % 4 == 1, k % 101).cast("int").alias("destruction_pct_claimed"),
        submitted.alias("submitted_at"),
        F.when(decided, F.timestamp_millis(F.unix_millis(submitted) + duration)).alias("decided_at"),
        duration.cast("long").alias("duration_ms"),
        verdict.alias("verdict"),
        F.when(decided, (k * 7) % 101).cast("int").alias("score"),
        sha2_digest(F.concat(F.lit("state-"), k.cast("string"))).alias("latest_state_hash"),
        F.when(k % 4 == 0, F.concat(F.lit("USR-"), (F.col("o_custkey") % n_staff).cast("string"))).alias("assigned_to"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.concat(F.lit("USR-"), k.cast("string")).alias("id"),
            F.concat(F.lit("user"), k.cast("string"), F.lit("@example.org")).alias("email"),
            F.sha2("s_name", 256).alias("password_hash"),
            F.col("s_name").alias("name"),
            F.when(k % 2 == 0, "inspector").otherwise("supervisor").alias("role"),
            F.col("n_name").alias("district"),
            F.timestamp_seconds(1704067200 + k * 86400).alias("created_at"),
        )
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim that has an inspector, re-assigned once when its key is a multiple of 8."""
    k = F.col("o_orderkey")
    n_staff = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()
    base = table(spark, sf_dir, "orders").where(k % 4 == 0)
    rounds = base.select(
        "*", F.explode(F.when(k % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("r")
    )
    return rounds.select(
        claim_id(k).alias("claim_id"),
        F.concat(F.lit("USR-"), ((F.col("o_custkey") + F.col("r") * 3) % (n_staff + 2)).cast("string")).alias("assigned_to"),
        F.lit("USR-1").alias("assigned_by"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("r") * 3600).alias("assigned_at"),
    )


def bit_string(hex_digest: Column) -> Column:
    """64 bits of a hex digest as a string of 0 and 1."""
    half = lambda at: F.lpad(F.conv(F.substring(hex_digest, at, 8), 16, 2), 32, "0")
    return F.concat(half(1), half(9))


def file_key() -> Column:
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return F.concat_ws(
        "-", F.lit("ev"), *[F.col(p).cast("string") for p in parts], F.col("l_quantity").cast("int").cast("string")
    )


def _kind() -> Column:
    return _pick(EVIDENCE_KINDS, (F.col("l_partkey") + F.col("l_linenumber")) % 7)


def part_lat() -> Column:
    """Forty fields stand for the plots of all parts."""
    return F.lit(17.5) + (F.col("l_partkey") % 40 * 9).cast("double") / 100


def part_lon() -> Column:
    return F.lit(72.9) + (F.col("l_partkey") % 40 * 13 % 52).cast("double") / 10


def evidence(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Evidence files from ``lineitem``, which may also be a stream."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = _kind()
    # one part in ten stands for a picture that is used again with a few bits changed
    reused = F.concat(
        F.substring(bit_string(F.sha2(F.concat(F.lit("part-"), part.cast("string")), 256)), F.lit(1), 64 - line),
        F.repeat(F.lit("0"), line),
    )
    single = bit_string(F.sha2(file_key(), 256))
    gps = F.when(part % 5 != 0, F.struct(part_lat().alias("lat"), part_lon().alias("lon")))
    lineitem = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return lineitem.select(
        file_key().alias("file_id"),
        claim_id(F.col("l_orderkey")).alias("claim_id"),
        line.alias("seq"),
        kind.alias("kind"),
        F.concat(kind, F.lit("-"), part.cast("string"), F.lit(".jpg")).alias("filename"),
        _pick(["image/jpeg", "image/png", "application/pdf", "image/gif"], part % 4).alias("mime_type"),
        (F.col("l_quantity") * 300000).cast("long").alias("size_bytes"),
        sha2_digest(F.when(part % 10 == 0, part.cast("string")).otherwise(file_key())).alias("sha256"),
        F.when(kind.isin(*C.IMAGE_KINDS), F.when(part % 10 == 0, reused).otherwise(single)).alias("p_hash"),
        F.struct(
            (part % 3 != 0).alias("present"),
            F.when(part % 11 == 0, "Photoshop").alias("software"),
            F.lit(None).cast("string").alias("device"),
            F.lit(None).cast("timestamp").alias("taken_at"),
            gps.alias("gps"),
        ).alias("exif"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short scanned texts for every evidence file; some are empty."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    kind = _kind()
    owner = F.when(part % 3 == 0, k + 9).otherwise(k)
    number = _pick([p[0] for p in C.POLICIES] + ["MH-99-0001"], part % 5)
    amount = (F.col("l_extendedprice") / 4).cast("long").cast("string")
    text = (
        F.when(part % 13 == 0, "")
        .when(kind == "photo", F.concat(F.lit("field "), _pick(["flood water", "dry cracked soil", "dead cattle", "green crop"], part % 4)))
        .when(kind == "bill", F.concat(F.lit("policy "), number, F.lit(" insured: "), person(k), F.lit(" claim amount "), amount))
        .when(kind == "id", F.concat(F.lit("Name: "), person(k), F.lit("\nvoter card")))
        .when(
            kind == "registry",
            F.concat(
                F.lit("sale deed khasra no 45/"), (part % 90 + 1).cast("string"), F.lit("\nDistrict Nanded\n"),
                F.when(part % 7 == 1, F.lit("## ## ##"))
                .when(part % 2 == 0, F.concat(F.lit("क्रेता: "), person_deva(owner), F.lit(" पुत्र ")))
                .otherwise(F.concat(F.lit("owner: "), person(owner))),
            ),
        )
        .when(
            kind == "aadhaar",
            F.concat(
                F.lit("GOVERNMENT OF INDIA\nName: "), person(k), F.lit("\nDoB: 03/01/1995\nMALE\n5522 6616 "),
                F.lpad((part % 10000).cast("string"), 4, "0"),
            ),
        )
        .when(
            kind == "policy",
            F.concat(
                F.lit("Policy No: "), number, F.lit("\nInsured Name: "), person(k), F.lit("\nSum Insured: Rs "),
                (part * 50 + 5000).cast("string"), F.lit("\nflood drought"),
            ),
        )
        .otherwise("")
    )
    return table(spark, sf_dir, "lineitem").select(
        file_key().alias("file_id"), text.alias("text"), text.rlike("[ऀ-ॿ]").alias("hindi")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a role header put in front, by ``doc_id % 4``."""
    k = F.col("doc_id")
    header = (
        F.when(
            k % 4 == 0,
            F.concat(
                F.lit("GOVERNMENT OF INDIA\nName: "), person(k), F.lit("\nDoB: 03/01/1995\nMALE\n5522 6616 "),
                F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n"),
            ),
        )
        .when(
            k % 4 == 1,
            F.concat(
                F.lit("sale deed khasra no 45/"), (k % 90 + 1).cast("string"),
                F.lit("\nDistrict Nanded village Rampur area 2.5 hectare maharashtra\n12/03/2019 Rs 50,000\nowner: "),
                person(k), F.lit(" 77\n"),
            ),
        )
        .when(
            k % 4 == 2,
            F.concat(
                F.lit("policy no: "), _pick([p[0] for p in C.POLICIES], F.floor(k / 4) % 4),
                F.lit("\nInsured Name: "), person(k), F.lit("\nSum Insured: Rs "), (k * 10 + 5000).cast("string"),
                F.lit("\nflood drought\n"),
            ),
        )
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select(k, F.concat(header, F.col("text")).alias("text"))


def event_status() -> Column:
    return _by_key(EVENT_STATUS, F.col("event_type"))


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return dense_sequence(events, "user_id", F.to_date("ts"), [F.col("ts"), F.col("event_id")])


def trail_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to seal, one chain per user."""
    return _event_rows(spark, sf_dir).select(
        claim_id(F.col("user_id")).alias("claim_id"),
        "seq",
        sha2_digest(F.concat(F.lit("state-"), F.col("event_id").cast("string"))).alias("state_hash"),
        _by_key(EVENT_STATUS, F.col("event_type")).alias("status"),
        F.unix_seconds("ts").alias("ts"),
        F.lit("svc").alias("recorded_by"),
        F.col("props").alias("note"),
    )


def transition_columns() -> list[Column]:
    return [
        claim_id(F.col("user_id")).alias("claim_id"),
        F.col("seq"),
        _by_key(EVENT_REQUEST, F.col("event_type")).alias("requested"),
        F.repeat(F.col("props"), (1 + F.col("event_id") % 3).cast("int")).alias("note"),
        F.lit("ops-agent").alias("reviewer"),
        F.col("ts"),
    ]


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(spark, sf_dir).select(*transition_columns())


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows with repeats: the same user and type on one day counts as one."""
    return events.select(
        claim_id(F.col("user_id")).alias("claim_id"),
        sha2_digest(F.col("event_type")).alias("state_hash"),
        event_status().alias("status"),
        F.lit("svc").alias("recorded_by"),
        F.col("props").alias("note"),
        F.to_date("ts").cast("timestamp").alias("ts"),
        F.col("event_id"),
    )


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(table(spark, sf_dir, "events"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-bit hashes of all vectors and a planted copy of each with 0..8 bits flipped."""
    signs = F.transform("embedding", lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)))
    base = _embeddings(spark, sf_dir).select("vec_id", signs.alias("bits"))
    v = F.col("vec_id")
    flipped = F.transform(
        F.col("bits"),
        lambda b, p: F.when(((p * 31 + v) % 64) < (v % 9), 1 - b).otherwise(b),
    )
    copies = base.withColumn("bits", flipped).withColumn("vec_id", v + PLANTED)
    both = base.unionByName(copies)
    return both.select(
        F.concat(F.lit("IMG-"), F.col("vec_id").cast("string")).alias("file_id"),
        claim_id(F.col("vec_id")).alias("claim_id"),
        F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("p_hash"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("vec_id")).alias("created_at"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return _embeddings(spark, sf_dir).where(v % 2 == 0).select(
        claim_id(v).alias("claim_id"),
        F.concat(F.lit("mem-"), v.cast("string")).alias("file_id"),
        F.when(F.col("label") % 2 == 1, "fraud").otherwise("genuine").alias("label"),
        F.lit("pipeline").alias("source"),
        F.col("embedding").alias("vec"),
        F.timestamp_seconds(F.lit(820454400) + v * 3600).alias("at"),
        v.alias("seq"),
    )


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a photo; prompt scores need no memory kept apart."""
    v = F.col("vec_id")
    return _embeddings(spark, sf_dir).select(F.concat(F.lit("IMG-"), v.cast("string")).alias("file_id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors ask; the other half is what the memory holds."""
    v = F.col("vec_id")
    return _embeddings(spark, sf_dir).where(v % 2 == 1).select(
        claim_id(v).alias("claim_id"),
        F.concat(F.lit("IMG-"), v.cast("string")).alias("file_id"),
        F.lit(1).alias("seq"),
        F.lit("photo").alias("kind"),
        F.col("embedding").alias("vec"),
        F.timestamp_seconds(F.lit(820454400) + v * 3600).alias("run_at"),
    )


def prompt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vectors of the table stand for the fixed prompts."""
    p = F.col("vec_id")
    within = lambda lo, hi: p.between(lo, hi)
    signal = F.when(p <= 5, "staged").when(p <= 12, "ai_gen").when(p <= 48, "relevance").otherwise("ladder")
    side = F.when(
        within(0, 2) | within(6, 9) | within(13, 15) | within(25, 27) | within(37, 39), "pos"
    ).when(p <= 48, "neg").otherwise("pos")
    loss = F.when(within(13, 24), "flood").when(within(25, 36), "drought").when(within(37, 48), "livestock")
    step = F.floor((p - 49) / 2)
    rung = F.when(p >= 49, _pick([r for r, _ in C.LADDER], F.greatest(step, F.lit(0)) % 6))
    weight = F.when(p >= 49, F.element_at(F.array(*[F.lit(w) for _, w in C.LADDER]), (F.greatest(step, F.lit(0)) % 6 + 1).cast("int")))
    return _embeddings(spark, sf_dir).where(p <= 60).select(
        p.cast("int").alias("pos"),
        signal.alias("signal"),
        loss.alias("loss_type"),
        side.alias("side"),
        rung.alias("rung"),
        weight.alias("weight"),
        F.col("embedding").alias("vec"),
    )


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every photo and satellite file of the evidence view."""
    emb = _embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("vec"))
    n = _embeddings(spark, sf_dir).agg(F.count("*").alias("n")).scalar()
    kind = _kind()
    files = table(spark, sf_dir, "lineitem").where(kind.isin(*C.IMAGE_KINDS)).select(
        file_key().alias("file_id"),
        claim_id(F.col("l_orderkey")).alias("claim_id"),
        F.col("l_linenumber").alias("seq"),
        kind.alias("kind"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % n).alias("vec_id"),
    )
    return files.join(emb, "vec_id").drop("vec_id")


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = F.col("l_linenumber") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        tile_id(part_lat(), part_lon()).alias("tile_id"),
        F.to_date("l_shipdate").alias("obs_date"),
        F.when(red, "red").otherwise("nir").alias("band"),
        F.when(red, F.lit(0.04) + F.col("l_tax")).otherwise(F.lit(0.12) + F.col("l_discount") * 4).alias("value"),
    )


def policies(spark: SparkSession) -> DataFrame:
    from tallygrain.schemas import POLICIES

    return spark.createDataFrame(C.POLICIES, POLICIES)
