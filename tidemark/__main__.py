"""python -m tidemark list | run NAME FOLDER [ROWS] | explain NAME FOLDER | sql FOLDER TEXT"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tidemark import catalog, sqlapi


def main(args: list[str]) -> int:
    """Lists the queries, shows or explains one over a folder of tables, or runs a SQL text over them."""
    match args:
        case ["list"]:
            print("\n".join(sorted(catalog.QUERIES)))
        case ["run", name, folder, *rest] if name in catalog.QUERIES:
            catalog.QUERIES[name](_session(), folder).show(int(rest[0]) if rest else 20, truncate=False)
        case ["explain", name, folder] if name in catalog.QUERIES:
            catalog.QUERIES[name](_session(), folder).explain("formatted")
        case ["sql", folder, text]:
            sqlapi.views(_session(), folder).sql(text).show(truncate=False)
        case _:
            print(__doc__)
            return 2
    return 0


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
