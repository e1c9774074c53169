"""Stage times per query from a Spark event log (no UI, no REST).

Run the bench with ``BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX)``, then:

  python tools/stage_times.py <event log dir> [top]

Queries are told apart by the job description bench.py sets for each one.
"""

from __future__ import annotations

import collections
import glob
import json
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        if path.endswith(".zstd"):
            import zstandard
            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            raw = b"".join(iter(lambda: reader.read(1 << 20), b""))
        else:
            raw = fh.read()
    # Split on newlines only: plan text inside events may hold other line separators.
    return (line for line in raw.decode("utf-8", "replace").split("\n") if line.strip())


def main():
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    job_of_stage, stages = {}, {}
    for path in sorted(glob.glob(f"{root}/**/events_*", recursive=True)
                       + glob.glob(f"{root}/app-*") + glob.glob(f"{root}/local-*")):
        for line in _lines(path):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (e.get("Properties") or {}).get("spark.job.description", "")
                for sid in e.get("Stage IDs", []):
                    job_of_stage[sid] = desc
            elif kind == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (
                    (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000,
                    si["Number of Tasks"], job_of_stage.get(si["Stage ID"], ""), si["Stage Name"])
    per_query = collections.defaultdict(float)
    for dur, _, desc, _ in stages.values():
        per_query[desc or "(untagged)"] += dur
    print("stage seconds per query:")
    for q, t in sorted(per_query.items(), key=lambda x: -x[1]):
        print(f"  {t:8.2f}  {q}")
    print(f"top {top} stages:")
    for dur, tasks, desc, name in sorted(stages.values(), key=lambda x: -x[0])[:top]:
        print(f"  {dur:8.2f}s  tasks={tasks:5d}  {desc:22s} {name[:60]}")


if __name__ == "__main__":
    main()
