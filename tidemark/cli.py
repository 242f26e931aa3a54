"""A shell over an engine: statements, and reports by backslash commands.

    python -m tidemark.cli /path/to/database
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Engine, Session
from tidemark.errors import TidemarkError

HELP = "statements end with a line; \\projections \\session \\telemetry [shapes] \\advice [log] \\actions [log] \\cache [clear] \\changes <table> [after] [max] \\q"


def command(engine: Engine, session: Session, line: str) -> DataFrame | None:
    """The report a backslash command asks for; None if it only acts."""
    name, *rest = line[1:].split()
    if name == "projections":
        return engine.show_projections()
    if name == "session":
        return engine.show_session(session)
    if name == "telemetry":
        return engine.show_shapes() if rest[:1] == ["shapes"] else engine.show_telemetry()
    if name == "advice":
        return engine.show_advice(rest[:1] == ["log"])
    if name == "actions":
        return engine.show_actions(rest[:1] == ["log"])
    if name == "cache":
        if rest[:1] == ["clear"]:
            engine.cache.clear()
            return None
        return engine.show_cache()
    if name == "changes" and rest:
        return engine.changes(rest[0], int(rest[1]) if len(rest) > 1 else 0, int(rest[2]) if len(rest) > 2 else 100)
    raise TidemarkError(HELP)


def main() -> None:
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    engine = Engine(spark, sys.argv[1])
    session = engine.session()
    for line in sys.stdin:
        line = line.strip()
        if line == "\\q":
            break
        if not line:
            continue
        try:
            out = command(engine, session, line) if line.startswith("\\") else session.sql(line)
            if out is not None:
                out.show(truncate=False)
        except TidemarkError as e:
            print(f"error: {e}")


if __name__ == "__main__":
    main()
