"""Steps that need their neighbours: streaming forms of operators the batch side writes with windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T

from framestory.operators.posture import EDGE, activity_machine, pose_machine, pose_state
from framestory.operators.quality import lighting_step
from framestory.functions.numbers import rounded_number
from framestory.operators.sampling import SkipConfig

SKIP_STREAM_OUT = T.StructType([
    T.StructField("frame_number", T.LongType()), T.StructField("smoothed_skip", T.LongType()), T.StructField("protected", T.BooleanType()),
    T.StructField("selected", T.BooleanType())])


def skip_stream_step(cfg: SkipConfig = SkipConfig()):
    """Adaptive selection on raw motion; the state adds frames seen and protection left.

    An optional ``signal`` column triggers protection from outside.
    """
    def tier_skip(m: float) -> int:
        raw = (cfg.static_skip if m < 0.005 else cfg.low_skip if m < 0.020 else cfg.medium_skip if m < cfg.protection_threshold else cfg.high_skip)
        return max(cfg.min_skip, min(cfg.max_skip, raw))

    def step(state, rows, last):
        seen, left, ema, counter = state or [0, 0, 3.0, 0]
        out = []
        signals = rows["signal"] if "signal" in rows else [False] * len(rows)
        for frame, m, sig in zip(rows["frame_number"], rows["motion_fraction"], signals):
            if sig:
                left = cfg.protection_window
            warm = seen < cfg.warmup
            if not warm and m >= cfg.protection_threshold:
                left = cfg.protection_window
            prot = not warm and left > 0
            if warm:
                skip = cfg.medium_skip
            elif prot:
                skip, left = cfg.protection_skip, left - 1
            else:
                ema = cfg.ema_alpha * tier_skip(m) + (1.0 - cfg.ema_alpha) * ema
                skip = max(cfg.min_skip, min(cfg.max_skip, round(ema)))
            chosen = counter == 0
            if chosen:
                counter = skip
            counter = max(0, counter - 1)
            seen += 1
            out.append({"frame_number": int(frame), "smoothed_skip": skip, "protected": prot, "selected": chosen})
        return [seen, left, ema, counter], out

    return step


ZONE_STREAM_OUT = T.StructType([
    T.StructField("frame_number", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("direction", T.StringType()), T.StructField("cold_start", T.BooleanType())])


def zone_stream_step(state, rows, last):
    """Crossings of one zone by one track; the state is the last membership.

    Rows carry ``inside`` and ``zone_type``; the geometry is done in columns before.
    """
    entering = {"restricted": "restricted_zone_entry", "entry": "zone_entry", "exit": "zone_exit"}
    leaving = {"restricted": "restricted_zone_exit", "entry": "zone_exit", "exit": "zone_entry"}
    cold = {"restricted": "restricted_zone_entry", "entry": "zone_entry", "exit": "zone_entry"}
    was, out = state, []
    for frame, kind, now in zip(rows["frame_number"], rows["zone_type"], rows["inside"]):
        now = bool(now)
        if now != was and (was is not None or now):
            names = cold if was is None else entering if now else leaving
            out.append({"frame_number": int(frame), "event_type": names.get(kind, "zone_crossing"),
                        "direction": "entering" if now else "exiting", "cold_start": was is None})
        was = now
    return was, out


def machine_stream_step(fps: float = 25.0, window: int = 5):
    """Activity state machine on raw positions; the state adds the last position and speeds.

    Rows carry near_seat and optionally pose_label.
    """
    def step(state, rows, last):
        inner, prev, speeds = state or [None, None, []]
        v = []
        for frame, cx, cy in zip(rows["frame_number"], rows["cx"], rows["cy"]):
            if prev is not None:
                d = ((cx - prev[1]) ** 2 + (cy - prev[2]) ** 2) ** 0.5
                speeds = (speeds + [d / (max(frame - prev[0], 1) / fps)])[-window:]
            v.append(sum(speeds) / len(speeds) if speeds else 0.0)
            prev = [int(frame), float(cx), float(cy)]
        cx, cy = rows["cx"], rows["cy"]
        rows = rows.assign(smoothed_velocity=v, at_edge=(cx < EDGE) | (cx > 1.0 - EDGE) | (cy < EDGE) | (cy > 1.0 - EDGE))
        if "pose_label" not in rows:
            rows = rows.assign(pose_label=None)
        inner, out = activity_machine(inner, rows, last)
        return [inner, prev, speeds], out

    step.columns = ("frame_number", "timestamp_ms", "cx", "cy", "near_seat")
    return step


def pose_stream_step():
    """Temporal pose machine on raw boxes; the state adds the last centre and heights.

    Rows carry x1, y1, x2, y2 and pose_confidence.
    """
    def step(state, rows, last):
        inner, cx, heights = state or [None, None, []]
        names = []
        for x1, y1, x2, y2 in zip(rows["x1"], rows["y1"], rows["x2"], rows["y2"]):
            at, h = x1 + (x2 - x1) / 2, float(y2 - y1)
            lateral = 0.0 if cx is None else abs(at - cx)
            lower = len(heights) >= 3 and heights[-1] < heights[-3] - 0.03
            names.append(pose_state((x2 - x1) / max(h, 0.001), h, lateral, lower))
            cx, heights = float(at), [*heights, h][-3:]
        inner, out = pose_machine(inner, rows.assign(candidate=names), last)
        return [inner, cx, heights], out

    step.columns = ("frame_number", "timestamp_ms", "x1", "y1", "x2", "y2", "pose_confidence")
    return step


def lighting_stream_step(threshold: float = 10.0, min_run: int = 2, window_ms: float = 2000.0, smooth: int = 5, initial: float = 128.0, first: int = 10, least: int = 4):
    """Light switches from raw brightness.

    The state holds the last readable value, the rows that still wait for their
    smoothed value (half a window) or their baseline (the first rows wait for the
    first ten values), the smoothed values of the last ``window_ms``, and the
    inner machine.  What waits at the end of a video is worked off when it closes.
    """
    machine, half = lighting_step(threshold, min_run), smooth // 2

    def middle(values):
        s = sorted(values)
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2

    def step(state, rows, last):
        s = state or {"fill": None, "raw": [], "n": 0, "past": [], "first": [], "wait": [], "inner": None, "held": []}
        ready = []

        def smoothed(at, values):
            seq, frame, t = s["raw"][at][:3]
            v = middle(values)
            if len(s["first"]) < first:
                s["first"].append(v)
            us = int(t * 1000 // 1)
            s["past"] = [p for p in s["past"] if p[0] >= us - int(window_ms * 1000)]
            past = [p[1] for p in s["past"] if p[0] < us]
            s["past"].append([us, v])
            s["wait"].append([seq, frame, t, v, middle(past) if past else None])

        def released(done):
            while s["wait"] and (s["wait"][0][4] is not None or done or len(s["first"]) >= first):
                seq, frame, t, v, base = s["wait"].pop(0)
                base = middle(s["first"]) if base is None else base
                ready.append((seq, frame, t, rounded_number(base, 2), rounded_number(v, 2), rounded_number(v - base, 2)))

        for seq, frame, t, b in zip(rows["seq"], rows["frame_number"], rows["timestamp_ms"], rows["brightness"]):
            s["fill"] = s["fill"] if b is None or pd.isna(b) else float(b)
            s["raw"].append([int(seq), int(frame), float(t), initial if s["fill"] is None else s["fill"]])
            s["n"] += 1
            if s["n"] > half:
                at = len(s["raw"]) - 1 - half
                smoothed(at, [r[3] for r in s["raw"][max(0, at - half):]])
                s["raw"] = s["raw"][-(2 * half):]
            released(False)
        if last:
            for at in range(max(0, len(s["raw"]) - min(half, s["n"])), len(s["raw"])):
                smoothed(at, [r[3] for r in s["raw"][max(0, at - half):at + half + 1]])
            released(True)
        table = pd.DataFrame(ready, columns=["seq", "frame_number", "timestamp_ms", "baseline", "smoothed", "delta"])
        s["inner"], out = machine(s["inner"], table, last)
        if s["n"] < least:
            s["held"] += out
            return s, []
        out, s["held"] = s["held"] + out, []
        return s, out

    step.columns = ("seq", "frame_number", "timestamp_ms", "brightness")
    return step
