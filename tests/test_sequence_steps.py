"""Follow-up steps are judged on whole openings, by the rules of the original step check in plain Python."""

import duckdb
import pytest

from quillgate import terms as T
from quillgate.plans import catalog
from quillgate.plans import views as V

PENALTIES = dict(T.FOLLOW_UP_PENALTIES)
SOFT = {"opening_too_short", "body_too_short"}
#: What counts stands behind the first full stop, or the full stop stands first.
TEXTS = [
    "Hello. I am just checking in about the page", "Hi. Bumping this. Nobody has answered yet", "v2.1 of the page hides its button", "Too short. Yes",
    "...", ". A text that begins with a full stop", "", "One long sentence without any stop at all", "Nineteen letters. x", "Twenty letters. Yes!"]


def _step(lead, turn, text, earlier):
    i, flags = lead + turn * 2, []
    kind = V.FOLLOW_UPS[i % len(V.FOLLOW_UPS)]
    kind = kind if kind in T.FOLLOW_UP_TYPES else "value"
    angle = V.ANGLES[(i + lead % 3) % len(V.ANGLES)]
    body = "just checking in" if i % 6 == 5 else "" if i % 9 == 7 else text
    flags += ["missing_angle"] * (not angle) + ["missing_opening_line"] * (not text) + ["missing_body_text"] * (not body)
    flags += ["missing_cta"] * (i % 7 == 3 and kind != "breakup")
    key = angle.split(":")[0].strip().lower()
    flags += ["repeated_angle"] * (bool(angle) and any(a in key or key in a for a in earlier))
    flags += ["opening_too_short"] * (0 < len(text) < 20) + ["body_too_short"] * (0 < len(body) < 30)
    flags += ["generic_followup_language"] * (kind != "breakup" and any(w in f"{text} {body}".lower() for w in T.GENERIC_FOLLOW_UPS))
    if angle:
        earlier.add(key)
    raw = 8.0 - sum(PENALTIES[f] for f in flags)
    return lead, turn + 1, kind, " | ".join(flags), max(0.0, min(10.0, raw)), bool(set(flags) - SOFT) or raw < 7


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """A folder with conversations, and the steps of plain Python: at most four, the last a break-up."""
    rows = [(lead, turn, "user", TEXTS[(lead * 7 + turn * 3) % len(TEXTS)]) for lead in range(1, 181) for turn in range(lead % 7)]
    folder = str(tmp_path_factory.mktemp("talks"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    steps, earlier, over = [], {}, set()
    for lead, turn, _, text in rows:
        if turn < 4 and lead not in over:
            steps.append(_step(lead, turn, text, earlier.setdefault(lead, set())))
            over |= {lead} if steps[-1][2] == "breakup" else set()
    return folder, steps


def _rows(spark, folder, name):
    """The query's rows, which are those of its check SQL."""
    df = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall())
    return got


def test_flags_are_of_whole_openings(spark, talks):
    folder, steps = talks
    assert _rows(spark, folder, "sequence_flags") == sorted(steps)
    assert {f for s in steps for f in s[3].split(" | ") if f} == set(PENALTIES)


def test_status_is_of_whole_openings(spark, talks):
    folder, steps = talks
    want = []
    for lead in sorted({s[0] for s in steps}):
        mine = [s for s in steps if s[0] == lead]
        scores, review = [s[4] for s in mine if s[4] > 0], any(s[5] for s in mine)
        mean = round(sum(scores) / len(scores), 1) if scores else 0.0
        want.append((lead, len(mine), mean, review, "needs_review" if review else "qc_passed"))
    assert _rows(spark, folder, "sequence_status") == want


def test_verdicts_are_of_whole_openings(spark, talks):
    folder, steps = talks
    assert _rows(spark, folder, "sequence_rows") == sorted((s[0], "base", s[1], True, "keep" if s[4] >= 5 else "drop") for s in steps)


def test_minimum_is_of_whole_openings(spark, talks):
    folder, steps = talks
    assert _rows(spark, folder, "sequence_minimum") == sorted(s[:2] for s in steps if s[4] >= 6)
