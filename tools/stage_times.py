"""Summarise a Spark event log per bench flow: jobs, stages, task time, shuffle, spill.

Usage: python tools/stage_times.py <event log file or folder>
The bench sets each timed flow as the job description (``bench:<flow>``).
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _files(path: str) -> list[str]:
    """Event log files below ``path`` (Spark 4 writes a folder of rolling ``events_*`` files)."""
    if not os.path.isdir(path):
        return [path]
    out = []
    for root, _, names in os.walk(path):
        out += [os.path.join(root, n) for n in sorted(names)
                if n.startswith("events_") or n.startswith("local-") or n.startswith("app-")]
    return out


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    job_flow: dict[int, str] = {}
    stage_job: dict[int, int] = {}
    flows = defaultdict(lambda: {"jobs": 0, "stages": 0, "tasks": 0, "task_ms": 0,
                                 "shuffle_read_mb": 0.0, "shuffle_write_mb": 0.0, "spill_mb": 0.0})
    for path in _files(sys.argv[1]):
        if path.endswith(".crc"):
            continue
        for line in _lines(path):
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description") or "(setup)"
                    job_flow[ev["Job ID"]] = desc
                    flows[desc]["jobs"] += 1
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = ev["Job ID"]
                elif kind == "SparkListenerStageCompleted":
                    sid = ev["Stage Info"]["Stage ID"]
                    flows[job_flow.get(stage_job.get(sid, -1), "(setup)")]["stages"] += 1
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    f = flows[job_flow.get(stage_job.get(ev.get("Stage ID"), -1), "(setup)")]
                    f["tasks"] += 1
                    f["task_ms"] += m.get("Executor Run Time", 0)
                    sr = m.get("Shuffle Read Metrics") or {}
                    sw = m.get("Shuffle Write Metrics") or {}
                    f["shuffle_read_mb"] += (sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)) / 2 ** 20
                    f["shuffle_write_mb"] += sw.get("Shuffle Bytes Written", 0) / 2 ** 20
                    f["spill_mb"] += (m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0)) / 2 ** 20
    print(f"{'flow':32s} {'jobs':>5s} {'stages':>6s} {'tasks':>6s} {'task s':>8s} {'shuf rd MB':>10s} "
          f"{'shuf wr MB':>10s} {'spill MB':>9s}")
    for name, f in sorted(flows.items(), key=lambda kv: -kv[1]["task_ms"]):
        print(f"{name[:32]:32s} {f['jobs']:5d} {f['stages']:6d} {f['tasks']:6d} {f['task_ms'] / 1000:8.1f} "
              f"{f['shuffle_read_mb']:10.1f} {f['shuffle_write_mb']:10.1f} {f['spill_mb']:9.1f}")


if __name__ == "__main__":
    try:
        main()
    except BrokenPipeError:      # output piped into `head`
        sys.stderr.close()
