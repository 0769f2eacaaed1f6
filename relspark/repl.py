"""A small interactive shell: ``python -m relspark.repl [path]``."""

from __future__ import annotations

import sys

from .dialect import split_statements
from .sources.cursor import tuple_factory
from .sources.database import Database

SHOWN = 1000


def table(names: list[str], rows: list[tuple]) -> str:
    """Rows as text: ``a | b``, a rule, and the number of rows."""
    if not rows:
        return "(no rows)"
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
    width = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    line = lambda c: " | ".join(x.ljust(w) for x, w in zip(c, width)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in width), *map(line, cells), f"({len(rows)} rows)"])


def answer(db: Database, line: str) -> str:
    """What the shell prints for a command or a batch of statements."""
    if line == ".tables":
        return "\n".join(sorted(db.catalog.tables))
    if line == ".indexes":
        return "\n".join(sorted(db.catalog.indexes))
    if line.startswith(".schema"):
        want = line.split()[1:]
        return "\n".join(r["sql"] for r in db.system_table(db.MASTER).collect() if not want or r["name"] in want)
    out = []
    for s in split_statements(line):
        cur = db.cursor()
        cur.row_factory = tuple_factory
        cur.execute(s)
        if cur.description:
            out.append(table([d[0] for d in cur.description], cur.fetchmany(SHOWN)))
        elif cur.rowcount >= 0:
            out.append(f"{cur.rowcount} rows changed.")
    return "\n".join(out)


def main(argv: list[str]) -> None:
    db, held = Database(*argv[:1]), ""
    while True:
        try:
            held += input("... " if held else "> ") + "\n"
        except EOFError:
            break
        line = held.strip()
        if line == ".exit":
            break
        if line.startswith(".") or line.endswith(";"):
            held = ""
            try:
                print(answer(db, line))
            except Exception as e:  # the shell goes on after any error
                print(f"{type(e).__name__}: {e}")
    db.close()


if __name__ == "__main__":
    main(sys.argv[1:])
