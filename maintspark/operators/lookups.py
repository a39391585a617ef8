"""Plain lists by system, and the names of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The systems' names.
ATA_NAMES = {
    "21": "Air Conditioning", "22": "Auto Flight", "23": "Communications", "24": "Electrical Power", "25": "Equipment/Furnishings", "26": "Fire Protection", "27": "Flight Controls",
    "28": "Fuel", "29": "Hydraulic Power", "30": "Ice and Rain Protection", "31": "Indicating/Recording Systems", "32": "Landing Gear", "33": "Lights", "34": "Navigation", "35": "Oxygen",
    "36": "Pneumatic", "45": "Central Maintenance System", "49": "Airborne Auxiliary Power", "51": "Standard Practices - Structures", "52": "Doors", "53": "Fuselage", "55": "Stabilizers",
    "56": "Windows", "57": "Wings", "62": "Rotor", "63": "Rotor Drive", "64": "Tail Rotor", "65": "Tail Rotor Drive", "67": "Rotors Flight Control", "71": "Powerplant",
    "72": "Turbine/Turboprop Engine", "73": "Engine Fuel and Control", "74": "Ignition", "75": "Air", "76": "Engine Controls", "77": "Engine Indicating", "78": "Exhaust", "79": "Oil",
    "80": "Starting", "83": "Accessory Gearboxes", "91": "Charts", "92": "Electrical System Installation",
}


def ata_name(df: DataFrame, ata_col: str = "ata_code") -> DataFrame:
    """Adds ata_name; systems without a name are called by their number."""
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame(list(ATA_NAMES.items()), "_ata string, _name string")  # 42 rows
    named = df.join(F.broadcast(names), F.col(ata_col) == F.col("_ata"), "left")
    return named.withColumn("ata_name", F.coalesce("_name", F.concat(F.lit("ATA "), F.col(ata_col), F.lit(" System")))).drop("_ata", "_name")


def occurrences_by_ata(occurrences: DataFrame, ata: str | None = None) -> DataFrame:
    """Occurrences of a system, or of all, by system and date."""
    return (occurrences if ata is None else occurrences.where(F.col("ata_code") == ata)).orderBy("ata_code", "occurrence_date", "id")


def parts_by_ata(parts: DataFrame, ata: str) -> DataFrame:
    return parts.where(F.col("ata_code") == ata)


def maintenance_log(logs: DataFrame) -> DataFrame:
    """Newest first."""
    return logs.orderBy(F.desc("log_date"), "id")


def related_maintenance(diagnostics: DataFrame, logs: DataFrame) -> DataFrame:
    """The log entries of each diagnosis's system. Systems are few, so entries of one meet many diagnoses: the result is that large."""
    return diagnostics.where("ata is not null").select("query_id", "ata").join(logs, "ata")
