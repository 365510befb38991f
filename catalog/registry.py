"""Registry of queries and of the SQL that gives the same rows."""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Means of two-decimal values may end exactly halfway between two rounded numbers,
# where the last bit of the sum decides. Both sides round after the same small step.
STEP = 1e-9


def with_step(sql: str) -> str:
    """Turn every ``round(x, 6)`` into ``round(x + STEP, 6)``."""
    out, i = "", 0
    while True:
        start = sql.find("round(", i)
        if start < 0:
            return out + sql[i:]
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inner = sql[start + 6 : end]
        if inner.endswith(", 6"):
            inner = f"({inner[:-3]}) + {STEP}, 6"
        out, i = out + sql[i:start] + f"round({inner})", end + 1


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_step(sql)
        return function

    return add
