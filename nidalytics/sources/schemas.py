"""Explicit schemas of raw and derived tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


# File names and columns of a raw deployment folder.
METADATA_FILE, LOG_FILE, DHT_FILE, TOF_FILE = "METADATA.TXT", "LOG.CSV", "DHT.CSV", "TOF.CSV"
REQUIRED_FILES = (METADATA_FILE, LOG_FILE, DHT_FILE, TOF_FILE)
LOG_RAW = _text("timestamp event device_id notes")
DHT_RAW = _text("timestamp temp1 hum1 temp2 hum2")
TOF_RAW = _text("timestamp tof_raw tof_smooth")
RAW_FILES = {LOG_FILE: LOG_RAW, DHT_FILE: DHT_RAW, TOF_FILE: TOF_RAW}
METADATA_KEYS = (
    "device_id", "deployment_id", "nestbox", "species", "eggs", "deployment_date", "deployment_time",
    "retrieval_date", "retrieval_time", "latitude", "longitude", "notes", "utc_offset_min",
)

_ROW = "deployment_id string, timestamp timestamp, src_block long, src_row long"
LOG_CLEAN = f"{_ROW}, event string, device_id string, notes string"
DHT_CLEAN = (
    f"{_ROW}, temp_in double, hum_in double, temp_out double, hum_out double, session_id int, dt_sec double, "
    "flag_dht_bad boolean, temp_diff double, hum_diff double"
)
TOF_CLEAN = (
    f"{_ROW}, tof_raw_mm double, tof_smooth_ema double, flag_tof_invalid boolean, session_id int, "
    "session_row long, dt_sec double, flag_ema_warmup boolean"
)
TOF_PROCESSED = (
    f"{TOF_CLEAN}, tof_smooth_r double, segment_id int, state_auto string, state_corrected string, "
    "correction_source string, bout_id long"
)
TOF_EXPORTED = TOF_PROCESSED.replace("bout_id long", "bout_id_auto long, bout_id_corrected long")
BOUTS = (
    "deployment_id string, state_corrected string, bout_start timestamp, bout_end timestamp, "
    "bout_duration double, n_readings long, mean_tof_mm double, bout_id long, flag_short boolean"
)
DAYS = (
    "deployment_id string, date date, sunrise string, sunset string, day_length_h double, "
    "first_off_start string, last_off_end string, prop_on_nest double, prop_off_nest double, "
    "prop_uncertain double, n_on_bouts int, n_off_bouts int, mean_on_bout_min double, mean_off_bout_min double"
)
DEVICES = (
    "deployment_id string, device_id string, nestbox string, species string, first_timestamp timestamp, "
    "last_timestamp timestamp, span_days double, n_sessions int, n_reboots int, total_downtime_min double, "
    "pct_downtime double, n_tof_total long, n_tof_invalid long, pct_tof_invalid double, n_tof_warmup long, "
    "n_dht_bad long, pct_dht_bad double"
)
DEPLOYMENTS = (
    "deployment_id string, device_id string, nestbox string, species string, eggs int, latitude double, "
    "longitude double, notes string, recording_year int, trim_start timestamp, trim_end timestamp, "
    "utc_offset_min int, folder string"
)
QUARANTINE = "source_file string, reason string, raw string"
CORRECTIONS = (
    "deployment_id string, seq long, t_min timestamp, t_max timestamp, d_min double, d_max double, action string"
)

CLEAN_TABLES = {"log_clean": LOG_CLEAN, "dht_clean": DHT_CLEAN, "tof_clean": TOF_CLEAN}
PROCESSED_TABLES = {
    "tof_processed": TOF_PROCESSED,
    "dht_processed": DHT_CLEAN,
    "bout_summary": BOUTS,
    "day_summary": DAYS,
    "device_summary": DEVICES,
}
EXPORTED_TABLES = {**PROCESSED_TABLES, "tof_processed": TOF_EXPORTED}
