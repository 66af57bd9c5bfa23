"""Registered queries and their check SQL, plus small helpers to write that SQL."""

QUERIES, SQL = {}, {}


def query(name, sql=None):
    """Register a query under a name, with the SQL the check engine runs on the same tables."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def with_(*ctes, select):
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def q(value):
    return "'" + value.replace("'", "''") + "'"


def items(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_sql(expr, terms):
    return "(" + " or ".join(f"contains({expr}, {q(t)})" for t in terms) + ")"


def starts_sql(expr, prefixes):
    return "(" + " or ".join(f"starts_with({expr}, {q(p)})" for p in prefixes) + ")"


def flags_sql(*pairs):
    cases = ", ".join(f"case when {cond} then {q(label)} end" for cond, label in pairs)
    return f"list_filter([{cases}], lambda x: x is not null)"


def join_sql(expr, sep=" | "):
    return f"coalesce(array_to_string({expr}, {q(sep)}), '')"


def dedupe_sql(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def pct_sql(part, whole):
    return f"case when {whole} > 0 then round_even(cast({part} as double) / {whole} * 100.0, 1) else 0.0 end"
