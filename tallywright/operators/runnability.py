"""Does code parse, run and leave a video? Running is opt-in: the code is not
trusted, so it gets a folder, a time limit and resource limits of its own."""

from __future__ import annotations

import ast
import os
import resource
import shutil
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits and names of the format.
SECONDS, STDOUT_BYTES, STDERR_BYTES, VIDEO, SCRIPT = 60.0, 600, 1500, "video.mp4", "simulation_code.py"
RESULT = "syntax_ok boolean, runs_without_error boolean, produces_video_mp4 boolean, exit_code int, wall_time_s double, timed_out boolean, video_bytes long, video_path string, stdout_tail string, stderr_tail string, judge_error string"


def syntax_error(code: str | None) -> str | None:
    try:
        ast.parse(code or "")
    except SyntaxError as e:
        return f"SyntaxError: {e.msg} (line {e.lineno})"
    except (ValueError, RecursionError, MemoryError) as e:  # the last two: nested too deep for the parser
        return f"{type(e).__name__}: {e}"
    return None


def _syntax_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for codes in batches:
        yield codes.map(syntax_error, na_action=None)


def syntax_errors(code: Column) -> Column:
    """Why code doesn't parse, else null."""
    return F.pandas_udf(_syntax_batches, "string")(code)


def tail(data: bytes | None, size: int) -> str:
    return (data or b"")[-size:].decode(errors="replace")


def execute(code: str, seconds: float = SECONDS, keep: str | None = None, memory_mb: int = 2048) -> dict:
    """Run code in a folder of its own. A video counts even if the run failed."""
    error = syntax_error(code)
    out = dict.fromkeys((c.split()[0] for c in RESULT.split(", ")))
    out |= {"syntax_ok": error is None, "runs_without_error": False, "produces_video_mp4": False, "timed_out": False, "video_bytes": -1}
    if error:
        return out | {"judge_error": error}

    def limits() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20,) * 2)
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1,) * 2)

    folder = tempfile.mkdtemp()
    try:
        with open(os.path.join(folder, SCRIPT), "w") as f:
            f.write(code)
        began = time.monotonic()
        try:
            done = subprocess.run([sys.executable, "-I", SCRIPT], cwd=folder, timeout=seconds, capture_output=True, preexec_fn=limits, env={"PATH": os.environ.get("PATH", "")})
            out |= {"exit_code": done.returncode, "stdout_tail": tail(done.stdout, STDOUT_BYTES), "stderr_tail": tail(done.stderr, STDERR_BYTES)}
        except subprocess.TimeoutExpired as e:
            out |= {"exit_code": -1, "timed_out": True, "stdout_tail": tail(e.stdout, STDOUT_BYTES), "stderr_tail": tail(e.stderr, STDERR_BYTES)}
        except OSError as e:
            out |= {"exit_code": -2, "judge_error": f"{type(e).__name__}: {e}"}
        out["wall_time_s"] = time.monotonic() - began
        video = os.path.join(folder, VIDEO)
        if os.path.exists(video):
            out["video_bytes"] = os.path.getsize(video)
            if keep and out["video_bytes"] > 0:
                os.makedirs(os.path.dirname(keep), exist_ok=True)
                out["video_path"] = shutil.copy2(video, keep)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    out["runs_without_error"] = out["exit_code"] == 0 and not out["timed_out"]
    out["produces_video_mp4"] = out["video_bytes"] > 0
    return out


def run_codes(df: DataFrame, keys: list[str], code: str, seconds: float = SECONDS, keep_under: str | None = None) -> DataFrame:
    """Execute ``code`` of each row on the executors. Not called by any query."""
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + ", " + RESULT

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                keep = os.path.join(keep_under, *(str(row[k]) for k in keys), VIDEO) if keep_under else None
                out.append({k: row[k] for k in keys} | execute(row[code], seconds, keep))
            yield pd.DataFrame(out)

    return df.select(*keys, code).mapInPandas(run, schema)
