"""Reconciliation of records against five external registers, one row per (record, register)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith import config
from terralith.functions import text
from terralith.operators import parcels
from terralith.operators.rules import with_village

SYSTEMS = ["bhulekh", "bhunaksha", "igr", "lgd", "lrms"]


def _or(col: Column, fallback: str) -> Column:
    return F.when(text.is_set(col), col).otherwise(F.lit(fallback))


def _result(df: DataFrame, system: str, status: Column, reference: Column, detail: Column) -> DataFrame:
    severity = F.when(status == "matched", "low").when(status == "mismatch", "high").otherwise("medium")
    if system == "lgd":
        severity = F.when(status == "matched", "low").otherwise("medium")
    return df.select("record_id", F.lit(system).alias("source_system"), status.alias("match_status"),
                     severity.alias("severity"), reference.alias("external_reference"), detail.alias("detail"))


def ledger_check(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ownership ledger by khasra: owner (case-insensitive), khata and area within max(5 %, .005 ha)."""
    entry = ledger.groupBy("khasra_no").agg(F.min(F.struct("owner", "khata", "area_ha")).alias("e"))
    joined = records.join(entry, "khasra_no", "left")
    owner, khata, area = F.col("e.owner"), F.col("e.khata"), F.col("e.area_ha")
    hectares = F.coalesce("area_hectare", F.lit(0.0))
    issues = F.array_compact(F.array(
        F.when(text.is_set(F.col("owner_name")) & (F.lower(owner) != F.lower("owner_name")),
               F.format_string("owner: register='%s' vs extracted='%s'", owner, "owner_name")),
        F.when(text.is_set(F.col("khata_no")) & (khata != F.col("khata_no")),
               F.format_string("khata: register='%s' vs extracted='%s'", khata, "khata_no")),
        F.when((hectares != 0) & (F.abs(area - hectares) > F.greatest(hectares * 0.05, F.lit(0.005))),
               F.format_string("area: register=%.4f ha vs extracted=%.4f ha", area, hectares))))
    missing = F.col("e").isNull()
    status = F.when(missing, "not_found").when(F.size(issues) > 0, "mismatch").otherwise("matched")
    detail = (F.when(missing, F.format_string("Khasra %s is not present in the ledger.", _or(F.col("khasra_no"), "(blank)")))
              .when(F.size(issues) > 0, F.concat(F.lit("Cross-check found "), F.array_join(issues, "; "), F.lit(".")))
              .otherwise(F.format_string("Record agrees with the ledger entry for khasra %s (khata %s, %.4f ha).",
                                         "khasra_no", khata, area)))
    return _result(joined, "bhulekh", status,
                   F.concat(F.lit("bhulekh://ror/"), _or(F.col("khasra_no"), "unknown")), detail)


def map_check(records: DataFrame, cadastral: DataFrame) -> DataFrame:
    """Is there a polygon for the khasra?"""
    keys = parcels.plot_keys(cadastral).where("key_type = 'khasra_no'").select(F.col("key").alias("khasra_no"), "ord")
    plots = cadastral.select("ord", "plot_key", F.col("village").alias("p_village"), F.col("tehsil").alias("p_tehsil"))
    joined = records.drop("plot_key").join(keys.join(plots, "ord"), "khasra_no", "left")
    status = F.when(F.col("plot_key").isNull(), "not_found").otherwise("matched")
    detail = (F.when(F.col("plot_key").isNull(), "No cadastral polygon is available for this plot.")
              .otherwise(F.format_string("Cadastral polygon available (matched on khasra_no); village %s, tehsil %s.",
                                         "p_village", "p_tehsil")))
    return _result(joined, "bhunaksha", status, F.concat(
        F.lit("bhunaksha://plot/"), F.coalesce("plot_key", _or(F.col("khasra_no"), "unknown"))), detail)


def deed_check(records: DataFrame, deeds: DataFrame) -> DataFrame:
    """Deed register: every named party must be part of some registered party's name.

    A reference is looked up in its normalised form, else as written.
    """
    register = deeds.select("deed_key", F.struct("parties", "status", "year", "sro").alias("d"))
    ref = F.trim(F.coalesce("registration_no", F.lit("")))
    keyed = records.withColumn("_deed", text.deed_key(F.col("registration_no"))).withColumn("_ref", ref)
    joined = (keyed.join(register, F.col("_deed") == F.col("deed_key"), "left").drop("deed_key")
              .withColumnRenamed("d", "d1"))
    # the second lookup only concerns references the first one missed
    raw = register.withColumnRenamed("d", "d2")
    joined = joined.join(raw, F.col("d1").isNull() & (F.col("_ref") != F.col("_deed"))
                         & (F.col("_ref") == F.col("deed_key")), "left")
    deed = F.coalesce("d1", "d2")
    named = F.filter(F.array("previous_owner", "new_owner", "owner_name"), lambda p: text.is_set(p))
    unlisted = F.filter(named, lambda p: ~F.exists(deed["parties"], lambda r: F.contains(F.lower(r), F.lower(p))))
    status = F.when(deed.isNull(), "not_found").when(F.size(unlisted) > 0, "mismatch").otherwise("matched")
    detail = (F.when(deed.isNull(), F.format_string("Registration reference '%s' was not found in the deed register.",
                                                    _or(F.col("registration_no"), "(blank)")))
              .when(F.size(unlisted) > 0, F.format_string(
                  "Deed %s does not list %s among its parties (registered parties: %s).",
                  "_deed", F.array_join(unlisted, ", "), F.array_join(deed["parties"], ", ")))
              .otherwise(F.format_string("Deed %s verified: %s in %d at %s.", "_deed",
                                         deed["status"], deed["year"], deed["sro"])))
    reference = F.when(deed.isNull(), _or(F.col("registration_no"), "unknown")).otherwise(F.col("_deed"))
    return _result(joined, "igr", status, F.concat(F.lit("igr://deed/"), reference), detail)


def admin_check(records: DataFrame) -> DataFrame:
    """Village master: ok is matched, a wrong tehsil is a mismatch, anything else is not found."""
    looked = with_village(records, "_v")
    found = F.col("_v.status")
    status = F.when(found == "ok", "matched").when(found == "hierarchy_mismatch", "mismatch").otherwise("not_found")
    detail = (F.when(found == "ok", F.format_string(
        f"Village '%s' resolves to tehsil '%s' in the {config.DISTRICT} master.", "village", "_v.expected_tehsil"))
        .otherwise(F.format_string("Master-data check failed for village '%s' (status %s).",
                                   _or(F.col("village"), "(blank)"), found)))
    return _result(looked, "lgd", status, F.concat(F.lit("lgd://village/"), _or(F.col("village"), "unknown")), detail)


def downstream_check(records: DataFrame) -> DataFrame:
    """Downstream register: accepts every record and hands out a reference."""
    reference = F.concat(F.lit("lrms://khata/"), _or(F.col("khata_no"), "unknown"), F.lit("/"),
                         _or(F.col("khasra_no"), "unknown"))
    detail = F.format_string("Downstream register accepts khata %s / khasra %s.",
                             _or(F.col("khata_no"), "(blank)"), _or(F.col("khasra_no"), "(blank)"))
    return _result(records, "lrms", F.lit("matched"), reference, detail)


def all_checks(records: DataFrame, ledger: DataFrame, cadastral: DataFrame, deeds: DataFrame) -> DataFrame:
    parts = [ledger_check(records, ledger), map_check(records, cadastral), deed_check(records, deeds),
             admin_check(records), downstream_check(records)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_status(checks: DataFrame) -> DataFrame:
    """Per record: all_matched, or n_mismatch where n counts every status other than matched."""
    open_ones = F.count_if(F.col("match_status") != "matched")
    return checks.groupBy("record_id").agg(
        F.when(open_ones == 0, "all_matched").otherwise(F.format_string("%d_mismatch", open_ones))
        .alias("cross_db_status"))
