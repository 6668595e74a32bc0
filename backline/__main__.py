"""python -m backline QUERY SF_DIR [OUT]: run a query and show it or write it as Parquet; without arguments, list the queries."""

from __future__ import annotations

import sys

from .plans import catalogue
from .session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in catalogue.QUERIES:
        print(__doc__, *sorted(catalogue.QUERIES), sep="\n")
        return int(bool(args))
    rows = catalogue.QUERIES[args[0]](session(), args[1])
    rows.write.parquet(args[2]) if len(args) > 2 else rows.show(40, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
