"""Programs in notebooks, on a session here or a remote one.

    %load_ext lattica.lang.notebook
    %lattica_session sc://host:15002
    %%lattica --run totals --as out -- dir=/data
    ...program...

The cell's program is compiled as a module, whose names later cells may import by the module's name (--module). With --run
its function is called, with the named arguments after --, and with --as the result is kept under a name.
"""

from __future__ import annotations

import argparse
import shlex
from typing import Any

from pyspark.sql import SparkSession

from lattica.lang.evaluate import Program
from lattica.plans.dataset import Dataset


def session(remote: str | None = None) -> SparkSession:
    """The session at a Spark Connect address, or the one of this process."""
    builder = SparkSession.builder
    return (builder.remote(remote) if remote else builder).getOrCreate()


class Cells:
    """The programs of a notebook's cells; all share a Program, so cells can import one another."""

    def __init__(self, spark: SparkSession | None = None, paths: list[str] | None = None):
        self.paths = paths or ["."]
        self.connect(spark or session())

    def connect(self, spark: SparkSession) -> None:
        self.spark, self.program = spark, Program(spark, self.paths)

    def run(self, line: str, cell: str, names: dict[str, Any] | None = None) -> Any:
        """A cell with its options; names gets what --as keeps."""
        parser = argparse.ArgumentParser(prog="%%lattica", exit_on_error=False)
        parser.add_argument("--module", default="main")
        parser.add_argument("--run")
        parser.add_argument("--as", dest="kept")
        parser.add_argument("named", nargs="*")
        told = parser.parse_args(shlex.split(line))
        self.program.modules.pop(told.module, None)
        module = self.program.compile(cell, told.module)
        if not told.run:
            return sorted(module.scope)
        out = self.program.call(module, told.run, **dict(x.split("=", 1) for x in told.named))
        if told.kept and names is not None:
            names[told.kept] = out
        return out.frame() if isinstance(out, Dataset) else out


def load_ipython_extension(shell: Any) -> None:
    cells = Cells()
    shell.register_magic_function(lambda line, cell: cells.run(line, cell, shell.user_ns), "cell", "lattica")
    shell.register_magic_function(lambda line: cells.connect(session(line.strip() or None)), "line", "lattica_session")
