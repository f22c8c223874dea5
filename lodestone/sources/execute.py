"""Code and commands run in subprocesses on the executors, one row each; errors become rows."""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import sys
import tempfile
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Environment variables that pass to subprocesses.
SAFE_ENV = "PATH HOME USER SHELL TMPDIR TERM LANG".split()
RESULT = "stdout string, stderr string, exit_code int, timed_out boolean, capped boolean"


@dataclass(frozen=True)
class Language:
    """How code of a language is run: candidate programs, file suffix, and a prefix that makes FILE_CONTENT of the file named in FILE_PATH."""

    programs: tuple[str, ...]
    suffix: str
    file_content: str = ""


LANGUAGES = {
    "python": Language((sys.executable, "python3", "python"), ".py", "import os\nFILE_CONTENT = open(os.environ['FILE_PATH'], encoding='utf-8').read()\n"),
    "shell": Language(("bash", "sh"), ".sh", 'FILE_CONTENT="$(cat "$FILE_PATH")"\n'),
    "javascript": Language(("bun", "node"), ".js", "const FILE_CONTENT = require('fs').readFileSync(process.env.FILE_PATH, 'utf-8');\n"),
    "ruby": Language(("ruby",), ".rb", "FILE_CONTENT = File.read(ENV['FILE_PATH'])\n"),
    "perl": Language(("perl",), ".pl", "open(my $fh, '<', $ENV{FILE_PATH}); my $FILE_CONTENT = do { local $/; <$fh> };\n"),
    "php": Language(("php",), ".php"),
    "r": Language(("Rscript",), ".R"),
    "elixir": Language(("elixir",), ".exs"),
}


def available() -> dict[str, str]:
    """The first program found of each language on this machine."""
    return {name: path for name, lang in LANGUAGES.items() if (path := next((w for p in lang.programs if (w := shutil.which(p))), None))}


def run_one(language: str, code: str, timeout: float = 30, cap: int = 100 * 1024 * 1024, file_text: str | None = None, passthrough: tuple[str, ...] = ()) -> dict[str, object]:
    """Run code; its process group is killed at the time limit or at ``cap`` bytes of output."""
    program = available().get(language)
    if program is None:
        return {"stdout": "", "stderr": f"no program for {language}", "exit_code": None, "timed_out": False, "capped": False}
    env = {k: os.environ[k] for k in (*SAFE_ENV, *passthrough) if k in os.environ} | {"LANG": "en_US.UTF-8", "PYTHONDONTWRITEBYTECODE": "1", "PYTHONUNBUFFERED": "1", "NO_COLOR": "1"}
    with tempfile.TemporaryDirectory() as folder:
        if file_text is not None:
            Path(folder, "input").write_text(file_text, encoding="utf-8")
            env["FILE_PATH"] = str(Path(folder, "input"))
            code = LANGUAGES[language].file_content + code
        script = Path(folder, "code" + LANGUAGES[language].suffix)
        script.write_text(code, encoding="utf-8")
        process = subprocess.Popen([program, str(script)], cwd=folder, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        got, seen, over, late = {"out": bytearray(), "err": bytearray()}, threading.Lock(), threading.Event(), threading.Event()

        def stop() -> None:
            try:
                os.killpg(process.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass

        def expire() -> None:
            late.set()
            stop()

        def drain(pipe, name: str) -> None:
            while part := pipe.read1(65_536):
                with seen:
                    room = cap - len(got["out"]) - len(got["err"])
                    got[name] += part[: max(0, room)]
                    if len(part) > room:
                        over.set()
                if over.is_set():
                    stop()
                    return

        timer = threading.Timer(timeout, expire)
        timer.start()
        readers = [threading.Thread(target=drain, args=(p, n)) for p, n in ((process.stdout, "out"), (process.stderr, "err"))]
        for r in readers:
            r.start()
        for r in readers:
            r.join()
        status = process.wait()
        timer.cancel()
        process.stdout.close()
        process.stderr.close()
    return {"stdout": got["out"].decode(errors="replace"), "stderr": got["err"].decode(errors="replace"), "exit_code": None if late.is_set() or over.is_set() else status, "timed_out": late.is_set(), "capped": over.is_set()}


def execute(jobs: DataFrame, timeout: float = 30, cap: int = 100 * 1024 * 1024, parallel: int | None = None) -> DataFrame:
    """``jobs`` (job_id, language, code and, optionally, file_text) with the result of each; ``parallel`` deals them out first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job_id, language, code, text in frame.itertuples(index=False):
                try:
                    rows.append({"job_id": job_id} | run_one(language, code, timeout, cap, text))
                except Exception as e:  # an error is the row's result, as the other rows go on
                    rows.append({"job_id": job_id, "stdout": "", "stderr": f"{type(e).__name__}: {e}", "exit_code": None, "timed_out": False, "capped": False})
            out = pd.DataFrame(rows, columns=["job_id", "stdout", "stderr", "exit_code", "timed_out", "capped"])
            out["exit_code"] = out["exit_code"].astype("Int32")
            yield out

    text = F.col("file_text") if "file_text" in jobs.columns else F.lit(None).cast("string")
    slim = jobs.select(F.col("job_id").cast("long").alias("job_id"), "language", "code", text.alias("file_text"))
    dealt = slim if parallel is None else slim.repartition(parallel)
    return dealt.mapInPandas(run, f"job_id long, {RESULT}")


def result_text(results: DataFrame) -> DataFrame:
    """job_id, text: stdout, with stderr after it only if the exit code is not 0."""
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(True)) & (F.coalesce("stderr", F.lit("")) != "")
    return results.select("job_id", F.when(failed, F.concat("stdout", F.lit("\n"), "stderr")).otherwise(F.col("stdout")).alias("text"))
