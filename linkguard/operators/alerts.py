"""Alerts: throttling, creation, status changes, audit rows, lists and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions.chunkscan import CHUNK_BITS, chunked_scan, time_chunk
from linkguard.functions.sqlutil import add, in_list, lit


def micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
                  f"cast({ts} as timestamp_ntz))")


def alert_throttle(attempts: DataFrame, seconds: int = 60, id_col: str = "attempt_id",
                   chunk_seconds: int | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``emitted``: per (source_ip, alert_type) an attempt passes when at least ``seconds``
    have gone by since the last one that passed. Equal times: the lowest id passes.

    The fold runs on distinct (key, time) pairs, chunk by chunk, so a hot key is spread over its
    chunks of at most ``2 ** chunk_bits`` rows (or of ``chunk_seconds``, where that is given). A
    chunk's summary maps "first attempt let through" to "last attempt let through"; equal outcomes
    are merged into ranges.
    """
    gap = seconds * 1_000_000
    keys = ["source_ip", "alert_type"]
    times = (attempts.select(*keys, micros().alias("us"), id_col).groupBy(*keys, "us")
             .agg(F.min(id_col).alias(id_col)))

    def last_of(t, start):
        """Last attempt let through when ``t[start]`` (an index array) is the first one."""
        nxt = np.searchsorted(t, t + gap)
        cur = np.array(start)
        while True:
            to = nxt[cur]
            live = to < len(t)
            if not live.any():
                return t[cur]
            cur = np.where(live, np.minimum(to, len(t) - 1), cur)

    def summarize(g):
        t = g["us"]
        n = min(int(np.searchsorted(t, t[0] + gap)) + 1, len(t))  # what came before lies before t[0]
        first = np.arange(n)
        last = last_of(t, first)
        keep = np.append(last[1:] != last[:-1], True)
        return t[first][keep].tolist(), last[keep].tolist()

    def step(state, row):
        upto, last = row
        i = 0 if state is None else int(np.searchsorted(np.asarray(upto), state + gap))
        return int(last[i]) if i < len(last) else state

    def replay(g, state):
        t = g["us"]
        i = 0 if state is None or pd.isna(state) else int(np.searchsorted(t, int(state) + gap))
        hits = []
        while i < len(t):
            hits.append(i)
            i = int(np.searchsorted(t, t[i] + gap))
        return {id_col: g[id_col][hits]}

    emitted = chunked_scan(
        times, keys, ["us"], time_chunk("us", chunk_seconds) if chunk_seconds else chunk_bits,
        summary_schema="upto array<bigint>, last array<bigint>", state_schema="bigint",
        out_schema=f"{id_col} bigint", summarize=summarize, step=step, initial=None, replay=replay)
    return attempts.join(emitted.withColumn("emitted", F.lit(True)), id_col, "left").withColumn(
        "emitted", F.coalesce("emitted", F.lit(False)))


def coerce_alert(df: DataFrame) -> DataFrame:
    """Unknown types become ``other``, unknown severities ``low``."""
    return add(df, alert_type=f"CASE WHEN {in_list('alert_type', C.ALERT_TYPES)} THEN alert_type "
                              "ELSE 'other' END",
               severity=f"CASE WHEN {in_list('severity', C.SEVERITIES)} THEN severity "
                        "ELSE 'low' END")


def alert_create(attempts: DataFrame, ips: DataFrame, seconds: int = 60):
    """(new alerts, IP rows that have to be added)."""
    from linkguard.operators.upserts import missing_ips
    passed = alert_throttle(attempts, seconds).where("emitted")
    alerts = coerce_alert(passed).selectExpr(
        "attempt_id AS alert_id", "ts", "alert_type", "severity", "source_ip", "destination_ip",
        "description", "'new' AS status")
    return alerts, missing_ips(ips, alerts)


# --- status changes ------------------------------------------------------------------------
def _allowed(cur: str, new: str) -> str:
    return "(" + " OR ".join(f"({cur} = {lit(a)} AND {in_list(new, b)})"
                             for a, b in C.TRANSITIONS.items()) + ")"


def check_against(df: DataFrame, current: str = "old_status") -> DataFrame:
    """Success and message of a command, given the status it meets (NULL: no such alert)."""
    valid = in_list("new_status", C.STATUSES)
    ok = _allowed(current, "new_status")
    df = add(df, success=f"{valid} AND {current} IS NOT NULL AND {current} <> new_status AND {ok}")
    return add(df, success="coalesce(success, false)", message=f"""CASE
        WHEN NOT {valid} THEN concat("Invalid status '", new_status, "'")
        WHEN {current} IS NULL THEN concat('Alert ', alert_id, ' not found')
        WHEN {current} = new_status THEN concat('Alert is already "', new_status, '"')
        WHEN NOT {ok} THEN concat('Cannot transition "', {current}, '" → "', new_status, '"')
        ELSE concat('Alert updated: ', {current}, ' → ', new_status) END""",
               old_status=f"CASE WHEN {valid} THEN {current} END")


def transition_check(commands: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each command on its own against the stored status."""
    cur = alerts.select("alert_id", F.col("status").alias("old_status"))
    return check_against(commands.join(cur, "alert_id", "left"))


def status_history(commands: DataFrame, alerts: DataFrame, chunk_seconds: int | None = None,
                   chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Every command with the status it meets when all are applied in (ts, cmd_id) order."""
    names = list(C.STATUSES)
    code = {s: i for i, s in enumerate(names)}
    allowed = np.zeros((len(names), len(names)), dtype=bool)
    for a, bs in C.TRANSITIONS.items():
        for b in bs:
            allowed[code[a], code[b]] = True
    known = commands.join(alerts.select("alert_id", "status"), "alert_id").withColumn(
        "us", micros()).select("alert_id", "cmd_id", "us", "new_status", "status")

    def summarize(g):
        state = np.arange(len(names))
        for s in g["new_status"]:
            n = code.get(s)
            if n is not None:
                state = np.where(allowed[state, n], n, state)
        return state.tolist(), g["status"][0]

    def step(state, row):
        moves, start = row
        return names[moves[code[state or start]]]

    def replay(g, state):
        met, cur = [], state if isinstance(state, str) else g["status"][0]
        for s in g["new_status"]:
            met.append(cur)
            if s in code and allowed[code[cur], code[s]]:
                cur = s
        return {"cmd_id": g["cmd_id"], "met_status": np.array(met, dtype=object)}

    met = chunked_scan(
        known, ["alert_id"], ["us", "cmd_id"], time_chunk("us", chunk_seconds) if chunk_seconds else chunk_bits,
        summary_schema="moves array<int>, start string", state_schema="string",
        out_schema="cmd_id bigint, met_status string", summarize=summarize, step=step,
        initial=None, replay=replay)
    return check_against(commands.join(met, "cmd_id", "left"), "met_status").drop("met_status")


def apply_status(commands: DataFrame, alerts: DataFrame, history: DataFrame | None = None):
    """Alerts after all accepted commands; closing commands set who, why and when."""
    done = (history if history is not None else status_history(commands, alerts)).where("success")
    at = F.struct("ts", "cmd_id")
    closing = F.col("new_status").isin(C.CLOSED_STATUSES)

    def last_closing(col):
        return F.max_by(F.when(closing, F.col(col)), F.when(closing, at))
    last = done.groupBy("alert_id").agg(
        F.max_by("new_status", at).alias("n_status"), F.max(closing).alias("closed"),
        last_closing("user_name").alias("n_by"), last_closing("notes").alias("n_notes"),
        last_closing("ts").alias("n_at"))
    df = alerts.join(last, "alert_id", "left")
    return add(df, status="coalesce(n_status, status)",
               resolved_by="CASE WHEN closed THEN n_by ELSE resolved_by END",
               resolution_notes="CASE WHEN closed THEN n_notes ELSE resolution_notes END",
               resolved_at="CASE WHEN closed THEN n_at ELSE resolved_at END",
               ).drop("n_status", "closed", "n_by", "n_notes", "n_at")


def audit_rows(history: DataFrame) -> DataFrame:
    """One audit row per accepted status change."""
    keep = "map('ignoreNullFields', 'false')"
    return history.where("success").selectExpr(
        "cmd_id", "concat('alert_status:', new_status) AS action", "'alerts' AS table_affected",
        "alert_id AS record_id",
        f"to_json(named_struct('status', old_status), {keep}) AS old_values",
        f"to_json(named_struct('status', new_status, 'user', user_name, 'notes', notes), {keep}) "
        "AS new_values", "ts")


def bulk_update(alerts: DataFrame, where: str, new_status: str, user: str = "analyst",
                notes: str | None = None) -> DataFrame:
    """One result row per selected alert (``where`` picks the ids)."""
    cmds = alerts.where(where).select(
        F.col("alert_id"), F.col("status").alias("met"), F.lit(new_status).alias("new_status"),
        F.lit(user).alias("user_name"), F.lit(notes).cast("string").alias("notes"))
    return check_against(cmds, "met").drop("met")


def bulk_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("success"),
                       F.count_if(~F.col("success")).alias("failed"))


ACTIVE = in_list("status", C.ACTIVE_STATUSES)


# --- lists -----------------------------------------------------------------------------------
def severity_rank(col: str = "severity") -> Column:
    return F.expr(f"CASE {col} " + " ".join(
        f"WHEN '{s}' THEN {i}" for i, s in enumerate(C.SEVERITIES)) + " ELSE -1 END")


def newest(df: DataFrame, limit: int, ts: str = "ts", key: str = "alert_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def active(alerts: DataFrame, limit: int = 50, statuses=None) -> DataFrame:
    df = alerts.where(F.col("status").isin(statuses or C.ACTIVE_STATUSES))
    return df.orderBy(severity_rank(), F.desc("ts"), F.desc("alert_id")).limit(limit)


def search(alerts: DataFrame, term: str | None = None, severity: str | None = None,
           status: str | None = None, limit: int = 100, by_severity: bool = False) -> DataFrame:
    """Case-insensitive substring search with optional filters; ``status='Active'`` means the
    three open statuses."""
    df = alerts
    if term:
        hit = F.lit(False)
        for c in ("description", "source_ip", "alert_type"):
            hit = hit | F.contains(F.lower(c), F.lit(term.lower()))
        df = df.where(hit)
    if severity:
        df = df.where(F.col("severity") == severity)
    if status == "Active":
        df = df.where(ACTIVE)
    elif status:
        df = df.where(F.col("status") == status)
    if by_severity:
        return df.orderBy(severity_rank(), F.desc("ts"), F.desc("alert_id")).limit(limit)
    return newest(df, limit)


# --- statistics --------------------------------------------------------------------------------
def since(ts: str, as_of: str, n: int, unit: str) -> Column:
    """``ts`` within the last n units before ``as_of`` (a folded literal: the filter is pushed)."""
    return F.expr(f"{ts} >= TIMESTAMP_NTZ '{as_of}' - INTERVAL {n} {unit} "
                  f"AND {ts} <= TIMESTAMP_NTZ '{as_of}'")


def on_days(ts: str, start: str, end: str) -> Column:
    """Whole days from ``start`` to ``end``, as a half-open range."""
    return F.expr(f"{ts} >= TIMESTAMP_NTZ '{start} 00:00:00' AND "
                  f"{ts} < TIMESTAMP_NTZ '{end} 00:00:00' + INTERVAL 1 DAY")


def stats(alerts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return alerts.where(since("ts", as_of, days, "DAY")).groupBy("severity", "status").agg(
        F.count("*").alias("n"))


def today_summary(alerts: DataFrame, day: str) -> DataFrame:
    return alerts.where(on_days("ts", day, day)).agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES],
        *[F.count_if(F.col("status") == s).alias("new_alerts" if s == "new" else s)
          for s in C.STATUSES])


def trends(alerts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (alerts.where(since("ts", as_of, days, "DAY"))
            .groupBy(F.to_date("ts").alias("date"), "severity").agg(F.count("*").alias("n")))


def top_ips(alerts: DataFrame, limit: int = 10) -> DataFrame:
    df = alerts.groupBy("source_ip").agg(
        F.count("*").alias("alert_count"), F.max("ts").alias("last_alert"),
        F.array_join(F.array_sort(F.collect_set("alert_type")), ",").alias("types"))
    return df.orderBy(F.desc("alert_count"), "source_ip").limit(limit)


def reputation_hook(alerts: DataFrame, reputation: DataFrame) -> DataFrame:
    """New alerts whose source is known to be malicious."""
    rep = reputation.select(F.col("ip_address").alias("source_ip"), "threat_score",
                            "is_malicious")
    return alerts.join(rep, "source_ip").where("is_malicious")
