"""Land-register tables derived from the star-schema test tables.

Column expressions are written in the SQL subset that Spark and DuckDB share, so the oracle
queries can build the same inputs independently of the operators under test.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith import config, vocab
from terralith.functions import text
from terralith.functions.geo import box_ring

AS_OF = "2001-08-05 00:00:00"
SUBDIVISIONS = 6

_HEADS = ["Ar", "Bin", "Chit", "Dham", "Gop", "Hem", "Jag", "Kunj", "Lox", "Mad", "Nir", "Om", "Prab", "Rus",
          "Sud", "Tril", "Uday", "Vik", "Yud", "Zub", "Bhag", "Fak", "Ekl", "Ind"]
_TAILS = ["esh", "ita", "ulla", "onath", "ari", "idhar", "eswar", "umati", "anti", "ibala", "ojit", "arup",
          "endu", "iram", "okya", "udev", "amani", "ender", "ilash", "ishi", "upriya", "anjan", "opal", "imbar"]
_LAST = ["Sahoo", "Nayak", "Behera", "Pradhan", "Das", "Mohanty", "Patra", "Jena", "Swain", "Rout", "Mishra",
         "Tripathy", "Khuntia", "Barik", "Lenka", "Sethi", "Parida", "Biswal", "Gochhayat", "Hota", "Mallick",
         "Routray", "Satapathy", "Choudhury", "Dalai", "Guru", "Jagdev", "Kanungo", "Mahapatra", "Ojha", "Padhi"]
_MASTER = {v: t for t, villages in vocab.TEHSIL_VILLAGES.items() for v in villages}
_VILLAGES = list(_MASTER)
_TEHSILS = list(_MASTER.values())
N_VILLAGES = len(_MASTER)
_UNITS = ["acre", "hectare", "decimal", "bigha", "guntha", "kanal", "smoots", "", "Acres.", "sq m", "katha", "marla"]
_CLASSES = ["Irrigated land", "gharabari", "", "Old dry land", "Plantation land", "krishi", "forest",
            "st/ab plot", "common land"]
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "June", "July", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _pick(words: list[str], index: str) -> str:
    """SQL for the index-th word: a fixed-width slice of one literal."""
    width = max(map(len, words))
    packed = "".join(w.ljust(width) for w in words)
    return f"trim(substr('{packed}', cast({index} as int) * {width} + 1, {width}))"


def person(k: str) -> str:
    """SQL for a stable name of a number."""
    return (f"concat({_pick(_HEADS, f'({k}) % 24')}, {_pick(_TAILS, f'floor(({k}) / 24) % 24')}, ' ', "
            f"{_pick(_LAST, f'(({k}) * 7 + 3) % 31')})")


CENTS = "cast(round(o_totalprice * 100) as bigint)"
_DAY = "cast(cast(o_orderdate as date) as string)"
_D, _M, _Y = f"substr({_DAY}, 9, 2)", f"substr({_DAY}, 6, 2)", f"substr({_DAY}, 1, 4)"
_VILLAGE_NO = f"((c_nationkey * 3 + o_custkey) % {N_VILLAGES})"
# a fifth of the customers live in master villages; the rest in villages whose number grows with the data
_MASTER_VILLAGE = (f"case when o_custkey % 5 = 0 then {_pick(_VILLAGES, _VILLAGE_NO)} "
                   f"else concat('Mouza ', cast(cast(floor(o_custkey / 25) as bigint) as string)) end")
_HOLDER = person("o_custkey + case when o_orderkey % 3 = 0 then 1 else 0 end")

# name -> expression over orders x customer x nation
RECORD_COLUMNS: dict[str, str] = {
    "id": "o_orderkey",
    "record_id": "concat('LR-', cast(o_orderkey as string))",
    "doc_id": "concat('DOC-', cast(o_orderkey as string))",
    "khasra_no": "case when o_orderkey % 29 = 0 then '' when o_orderkey % 7 = 0 then cast(o_custkey as string) "
                 "else concat(cast(o_custkey as string), '/', cast(o_orderkey % 7 as string)) end",
    "khata_no": "case when o_orderkey % 17 = 0 then '' else cast(100 + o_custkey % 900 as string) end",
    "survey_no": "case when o_orderkey % 6 = 0 then '' else cast(o_custkey as string) end",
    "plot_no": "cast(o_orderkey % 50 as string)",
    "village": f"case when o_orderkey % 43 = 0 then '' when o_orderkey % 47 = 0 then 'बलरामपुर' "
               f"when o_orderkey % 19 = 0 then n_name "
               f"when o_orderkey % 23 = 0 then concat(substr({_MASTER_VILLAGE}, 1, 5), 'xyz') "
               f"else {_MASTER_VILLAGE} end",
    "tehsil": f"case when o_orderkey % 47 = 0 then 'खुर्दा सदर' when o_orderkey % 31 = 0 then '' "
              f"when o_orderkey % 11 = 0 then {_pick(_TEHSILS, f'(({_VILLAGE_NO} + 7) % {N_VILLAGES})')} "
              f"else {_pick(_TEHSILS, _VILLAGE_NO)} end",
    "district": "case when o_orderkey % 37 = 0 then 'Puri' when o_orderkey % 41 = 0 then '' "
                "when o_orderkey % 47 = 0 then 'खुर्दा' else 'Khordha' end",
    "owner_name": f"case when o_orderkey % 13 = 0 then '' when o_orderkey % 5 = 0 then "
                  f"concat(substr({_HOLDER}, 1, 2 + cast(o_custkey % 3 as int)), "
                  f"substr({_HOLDER}, 4 + cast(o_custkey % 3 as int))) else {_HOLDER} end",
    "guardian_name": f"case when o_orderkey % 4 = 1 then {person('o_custkey + 11')} else '' end",
    "address": f"concat('At ', {_MASTER_VILLAGE})",
    "area_value": f"cast({CENTS} % 1500 as double) / 100",
    "area_unit": _pick(_UNITS, "o_orderkey % 12"),
    "area_raw": f"case when o_orderkey % 53 = 0 then '' else trim(concat(cast(cast(floor(({CENTS} % 1500) / 100) "
                f"as bigint) as string), '.', lpad(cast({CENTS} % 100 as string), 2, '0'), ' ', "
                f"{_pick(_UNITS, 'o_orderkey % 12')})) end",
    "land_classification": _pick(_CLASSES, "o_orderkey % 9"),
    "mutation_no": "concat('MUT/', cast(100 + o_custkey % 900 as string), '/', " + _Y + ")",
    "mutation_date": f"case o_orderkey % 9 when 0 then 'not-a-date' "
                     f"when 1 then concat(cast(cast({_D} as int) as string), '-', cast(cast({_M} as int) as string), '-', {_Y}) "
                     f"when 2 then {_DAY} when 3 then concat({_D}, '/', {_M}, '/', substr({_Y}, 3, 2)) "
                     f"when 4 then '01/01/2999' when 5 then '32/13/2021' when 6 then '' "
                     f"when 7 then concat({_D}, ' ', {_pick(_MONTHS, f'cast({_M} as int) - 1')}, ' ', {_Y}) "
                     f"else concat({_D}, '/', {_M}, '/', {_Y}) end",
    "registration_no": f"case o_orderkey % 8 when 0 then '' "
                       f"when 1 then concat(cast(o_custkey as string), ' of ', cast(cast({_Y} as int) + o_orderkey % 3 - 1 as string)) "
                       f"when 2 then concat('BBSR-', cast(10 + o_custkey % 9000 as string), '-', cast(cast({_Y} as int) + o_orderkey % 3 - 1 as string)) "
                       f"when 3 then concat('OR-', lpad(cast(o_orderkey as string), 10, '1')) "
                       f"when 4 then 'REG-X-99-13' "
                       f"when 5 then concat(cast(o_custkey as string), '/', {_Y}) "
                       f"when 6 then concat('No. ', cast(10 + o_custkey % 9000 as string), ' of ', {_Y}) "
                       f"else concat('bbsr/', cast(10 + o_custkey % 9000 as string), '/', {_Y}) end",
    "previous_owner": f"case when o_orderkey % 4 <> 0 then '' when o_orderkey % 24 = 0 then {_HOLDER} "
                      f"else {person('o_custkey + case when o_orderkey % 3 = 0 then 0 else 1 end')} end",
    "new_owner": f"case when o_orderkey % 4 <> 0 then '' when o_orderkey % 16 = 0 then {person('o_custkey + 5')} "
                 f"else {_HOLDER} end",
    "document_type_label": f"case when o_orderkey % 10 = 9 then '{vocab.FORM_39A}' else 'record_of_rights' end",
    "status": "case when o_orderkey % 31 = 0 then 'rejected' when o_orderstatus = 'O' then 'pending_review' "
              "when o_orderstatus = 'P' then 'escalated' else 'approved' end",
    "record_confidence": f"cast({CENTS} % 10000 as double) / 100",
    "assigned_to_id": "case when o_orderkey % 5 = 0 then null else o_custkey % 12 end",
    "created_at": "o_orderdate + interval '1' second * cast(o_orderkey % 86400 as int)",
}

# deed references with their parties
DEED_COLUMNS: dict[str, str] = {
    "deed_key": f"concat(cast(o_custkey as string), '/', {_Y})",
    "party_1": person("o_custkey"),
    "party_2": f"case when o_orderkey % 5 = 0 then 'Anonymous Trust' else {person('o_custkey + 1')} end",
    "year": f"cast({_Y} as int)",
    "ord": "o_orderkey",
}

# features: one plot per part
PLOT_COLUMNS: dict[str, str] = {
    "ord": "p_partkey",
    "plot_key": "concat('PLT-', cast(p_partkey as string))",
    "khasra_no": f"concat(cast(p_partkey as string), '/', cast(1 + p_partkey % {SUBDIVISIONS} as string))",
    "survey_no": "case when p_partkey % 2 = 0 then cast(p_partkey as string) else '' end",
    "plot_no": "cast(p_partkey % 40 as string)",
    "village": _pick(_VILLAGES, f"p_partkey % {N_VILLAGES}"),
    "tehsil": _pick(_TEHSILS, f"p_partkey % {N_VILLAGES}"),
    "owner_hint": person("p_partkey"),
    "area_ha": "cast(5 + (p_partkey * 37) % 400 as double) / 100",
    "lon": f"{vocab.GRID_ORIGIN_LON} + (p_partkey % 200) * {vocab.GRID_STEP_LON}",
    "lat": f"{vocab.GRID_ORIGIN_LAT} + cast(floor(p_partkey / 200) as bigint) * {vocab.GRID_STEP_LAT}",
}

# one ledger row per customer
LEDGER_COLUMNS: dict[str, str] = {
    "khasra_no": f"concat(cast(c_custkey as string), '/', cast(1 + c_custkey % {SUBDIVISIONS} as string))",
    "owner": person("c_custkey"),
    "khata": "case when c_custkey % 7 = 0 then '999' else cast(100 + c_custkey % 900 as string) end",
    "area_ha": "cast(c_custkey % 600 as double) / 100",
}

# one audit row per event
AUDIT_COLUMNS: dict[str, str] = {
    "id": "event_id + 1",
    "log_id": "concat('AUD-', lpad(cast(event_id as string), 12, '0'))",
    "user_id": "cast(user_id as string)",
    "actor_label": "concat('user', cast(user_id % 40 as string))",
    "action": "event_type",
    "entity_type": "'record'",
    "entity_id": "concat('LR-', cast(user_id as string))",
    "field_name": "case when event_type = 'error' then 'village' else '' end",
    "old_value": "''",
    "new_value": "''",
    "ai_confidence": "cast(0 as double)",
    "detail": "props",
    "created_at": "ts",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns.items()])


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the shared checkpoint folder and read from there.

    It stands for a stored table: queries that read it several times prune and filter at its
    scan, and a lost executor re-reads files instead of deriving the rows again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = f"{config.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        config.write_table(build(), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of few, small files over the cluster before costly expressions; leave a large one as it is."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, key) if df.rdd.getNumPartitions() < width else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "records", lambda: derive_records(spark, sf_dir))


def derive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One land record per order, with hectares and parent plot computed by the operators."""
    joined = (_spread(table(spark, sf_dir, "orders"), "o_orderkey")
              .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
              .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    base = _project(joined, RECORD_COLUMNS)
    return base.withColumns({
        "area_hectare": text.to_hectare(F.col("area_value"), F.col("area_unit")),
        "parent_khasra_no": text.parent_khasra(F.col("khasra_no")),
        "state": F.lit("Odisha"),
    })


def sub_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows read off register pages, in decimals."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat(F.lit("LR-"), F.col("l_orderkey").cast("string")).alias("record_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_quantity").alias("area_value"), F.lit("decimal").alias("area_unit"),
        text.to_hectare(F.col("l_quantity"), F.lit("decimal")).alias("area_hectare"))


def deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deed register; a reference recorded twice keeps its first entry."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1")
    rows = _project(orders, DEED_COLUMNS)
    first = F.min_by(F.struct("party_1", "party_2", "year"), "ord").alias("e")
    return rows.groupBy("deed_key").agg(first).select(
        "deed_key", F.array("e.party_1", "e.party_2").alias("parties"), F.col("e.year").alias("year"),
        F.lit("Khordha SRO").alias("sro"), F.lit("registered").alias("status"),
        F.lit(9.75).alias("consideration_lakh"))


def cadastral(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _project(_spread(table(spark, sf_dir, "part"), "p_partkey"), PLOT_COLUMNS)
    ring = box_ring(F.col("area_ha"), F.col("lon"), F.col("lat"), vocab.PLOT_ASPECT)
    return base.withColumn("rings", F.array(ring)).drop("lon", "lat")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), LEDGER_COLUMNS)


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), AUDIT_COLUMNS)


def field_confidence(position: int, key: str = "id") -> Column:
    """A stable pseudo-confidence per (record, field)."""
    return (F.lit(50.0) + (F.col(key) * 7 + position * 13) % 50).cast("double")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "extractions", lambda: derive_extractions(spark, sf_dir))


def derive_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long field table of the records: one row per (record, field)."""
    base = records(spark, sf_dir)
    cells = []
    for position, field in enumerate(vocab.LABELS):
        source = {"area": "area_raw", "boundaries": "address"}.get(field, field)
        cells.append(F.struct(
            F.lit(field).alias("field_name"), F.col(source).alias("value"), F.col(source).alias("normalized_value"),
            F.when(F.col(source) != "", field_confidence(position)).otherwise(0.0).alias("confidence")))
    return base.select("record_id", F.inline(F.array(*cells))).withColumns(
        {"source": F.lit("regex"), "page": F.lit(1), "corrected_value": F.lit(None).cast("string")})


# ------------------------------------------------------------------ documents, words, boxes, pages
_DOC_SECONDS = "cast((doc_id * 7919) % 2592000 as int)"
DOCUMENT_COLUMNS: dict[str, str] = {
    "doc_id": "doc_id",
    "seq": "doc_id",
    "batch_id": "concat('B-', cast(doc_id % 50 as string))",
    "language": "lang",
    "status": "case doc_id % 10 when 0 then 'failed' when 1 then 'queued' when 2 then 'processing' "
              "when 3 then 'needs_review' when 4 then 'needs_review' else 'completed' end",
    "record_status": "case when doc_id % 7 = 0 then 'rejected' else 'pending_review' end",
    "total_latency_ms": "n_chars % 20000",
    "ocr_latency_ms": "n_chars % 7000",
    "created_at": f"timestamp '2024-01-01 00:00:00' + interval '1' second * {_DOC_SECONDS}",
}
BOX_COLUMNS: dict[str, str] = {
    "doc_id": "l_orderkey",
    "page": "1 + l_suppkey % 3",
    "seq": "l_linenumber",
    "label": "case cast(l_quantity as int) % 5 when 0 then 'table' when 1 then 'printed_text' "
             "when 2 then 'handwritten_text' when 3 then 'stamp' else 'map' end",
    "x": "cast(l_partkey % 400 as int)",
    "y": "cast(l_suppkey % 300 as int)",
    "w": "cast(case when cast(l_quantity as int) % 5 = 0 then 600 else 20 + l_partkey % 200 end as int)",
    "h": "cast(case when cast(l_quantity as int) % 5 = 0 then 500 else 10 + l_suppkey % 90 end as int)",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents")
    return base.selectExpr(*[f"{e} as {n}" for n, e in DOCUMENT_COLUMNS.items()], "sha2(text, 256) as file_hash")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated tokens of every document with a stable pseudo-confidence and box."""
    words = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("seq", "text")).where("text <> ''")
    n = F.length("text")
    return words.select("doc_id", "seq", "text", (F.lit(40) + (n * 7 + F.col("seq")) % 60).cast("double").alias("confidence"),
                        F.struct((F.col("seq") % 50 * 12).alias("x"), (F.floor(F.col("seq") / 50) * 20).cast("int").alias("y"),
                                 (n * 8).alias("w"), F.lit(16).alias("h")).alias("bbox"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), BOX_COLUMNS)


def register_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two register pages per record, composed from its columns, so that extraction has a known answer."""
    base = records(spark, sf_dir)

    def line(label: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(f"{label} : "), F.col(column)))

    first = F.concat_ws("\n", F.lit("RECORD OF RIGHTS"), line("District", "district"),
                        F.when(F.col("tehsil") != "", F.concat(F.lit("Tehsil / Block "), F.col("tehsil"))),
                        line("Village", "village"), line("Khata Number", "khata_no"), line("Khasra Number", "khasra_no"),
                        line("Survey Number", "survey_no"), line("Owner Name", "owner_name"), F.lit("End of sheet"))
    child = F.when((F.col("khasra_no") != "") & (F.col("parent_khasra_no") == ""), F.concat(
        F.lit("Sub Plot Khasra "), F.col("khasra_no"), F.lit("/1  Area 0.50 acre")))
    second = F.concat_ws("\n", F.when(F.col("area_raw") != "", F.concat(F.lit("Total Area "), F.col("area_raw"))),
                         line("Land Classification", "land_classification"), line("Mutation Date", "mutation_date"),
                         line("Mutation Number", "mutation_no"), child, F.lit("End of sheet"))
    pages = F.array(F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), second.alias("text")))
    return base.select(F.col("record_id").alias("doc_id"), F.inline(pages))


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of the Odia form per record with an owner: persons and boundary, then a table of two parcels."""
    base = records(spark, sf_dir).where(text.is_set(F.col("owner_name")))
    father, other = F.col("guardian_name"), F.col("new_owner")
    first = F.concat_ws(
        "\n", F.lit("Form No.39-A"), F.lit(vocab.PERSON_HEADERS[0]),
        F.concat("owner_name", F.when(father != "", F.concat(F.lit(f" {vocab.FATHER_MARK} "), father)).otherwise(""), F.lit(",")),
        F.when(other != "", F.concat(other, F.lit(","))), F.lit(vocab.BOUNDARY_HEADERS[0]),
        F.concat(*[x for side, mark in vocab.BOUNDARY_MARKS.items() for x in (F.lit(f"{mark} {side} of "), "address", F.lit(", "))]))
    k = (F.col("id") % 90).cast("string")
    second = F.concat_ws("\n", F.lit("Form No.39-A"), F.concat(F.lit("3"), k, F.lit("/1 0.25")), F.concat(F.lit("3"), k, F.lit("/2 1.50")))
    pages = F.array(F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), second.alias("text")))
    return base.select(F.col("record_id").alias("doc_id"), F.inline(pages))


USER_ROLES = ["reviewer", "supervisor", "admin", "operator"]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in USER_ROLES])
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.get(roles, (F.col("s_suppkey") % 4).cast("int")).alias("role"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer changes for a share of the records: (record_id, field_name, new_value)."""
    base = records(spark, sf_dir)
    k = F.col("id")
    cells = F.array(
        F.when(k % 3 == 0, F.struct(F.lit("village").alias("field_name"), F.lit("Balarampur").alias("new_value"))),
        F.when(k % 5 == 0, F.struct(F.lit("area").alias("field_name"), F.lit("1.5 acre").alias("new_value"))),
        F.when(k % 7 == 0, F.struct(F.lit("owner_name").alias("field_name"), F.col("owner_name").alias("new_value"))),
        F.when(k % 11 == 0, F.struct(F.lit("status").alias("field_name"), F.lit("approved").alias("new_value"))))
    return base.select("record_id", F.inline(F.array_compact(cells)))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('LR-', cast(o_orderkey as string)) as record_id",
        "case o_orderkey % 4 when 0 then 'approve' when 1 then 'reject' when 2 then 'escalate' else 'postpone' end as decision",
        "'' as comment")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = records(spark, sf_dir)
    k = F.col("id")
    cells = F.array(
        F.struct(F.lit("village").alias("field_name"), F.lit("Balarampur").alias("suggestion")),
        F.struct(F.lit("khata_no").alias("field_name"), F.when(k % 2 == 0, "77").otherwise("not-a-number").alias("suggestion")),
        F.struct(F.lit("owner_name").alias("field_name"), F.lit("Sunita Pradhan").alias("suggestion")))
    return base.select("record_id", F.inline(cells))
