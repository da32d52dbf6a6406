"""J1/J2 with several changes per row: equal to applying them one after another."""
import datetime as dt
import random

import pytest

from quizmart.operators import chains, changes

NOW = dt.datetime(2024, 2, 1)
D = dt.datetime(2023, 1, 1)
GAMES = "game_id long, course_id int, status string, start_date timestamp_ntz, finish_date timestamp_ntz"


def game_reason(o, n):
    if o == "waiting" and n is not None and n not in ("waiting", "active", "finished"):
        return "transition"
    if o == "active" and n is not None and n not in ("active", "finished"):
        return "transition"
    if o == "finished" and n is not None and n != "finished":
        return "finished_is_final"
    return "domain" if n is not None and n not in ("waiting", "active", "finished") else None


def one_after_another(games, rows, given):
    """The triggers as a loop over the changes: (decisions, snapshot)."""
    state = {g["game_id"]: dict(g) for g in games}
    out = []
    for c in rows:
        if c["game_id"] not in state:
            continue
        old = dict(state[c["game_id"]])
        new = old | {g: c[g] for g in given}
        o, n = old["status"], new["status"]
        reason = game_reason(o, n)
        if n == "active" and o is not None and o != "active" and new["start_date"] is None:
            new["start_date"] = NOW
        if n == "finished" and o is not None and o != "finished" and new["finish_date"] is None:
            new["finish_date"] = NOW
        out.append((c["seq"], *old.values(), *new.values(), reason))
        if reason is None:
            state[c["game_id"]] = new
    return out, [tuple(s.values()) for s in state.values()]


@pytest.mark.parametrize(("given", "partitions", "hot"), [
    (["status"], 1, False), (["status"], 24, True), (["status", "course_id"], 5, False), (["status", "start_date", "course_id"], 24, True)])
def test_games_in_turn(spark, given, partitions, hot):
    rng = random.Random(len(given) * 100 + partitions)
    statuses = ["waiting", "active", "finished", None, "bogus"]
    games = [{"game_id": i, "course_id": i % 3, "status": statuses[i % 4] if i % 9 else "odd", "start_date": D if i % 2 else None, "finish_date": D if i % 5 == 0 else None} for i in range(30)]
    rows = []
    for s in range(1500 if hot else 300):
        game = 7 if hot and s % 3 else rng.randrange(33)
        weights = [6, 6, 1, 1, 3] if hot else [2, 3, 2, 1, 1]
        rows.append({"game_id": game, "seq": s, "status": rng.choices(statuses, weights)[0], "course_id": rng.choice([1, 2, None]), "start_date": rng.choice([None, D])})
    g = spark.createDataFrame([tuple(x.values()) for x in games], GAMES)
    kinds = {"status": "string", "course_id": "int", "start_date": "timestamp_ntz"}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    c = spark.createDataFrame([(r["game_id"], r["seq"], *(r[x] for x in given)) for r in shuffled], "game_id long, seq int, " + ", ".join(f"{x} {kinds[x]}" for x in given))
    snapshot, decisions, rejected = chains.apply_game_changes(g, c, NOW, ["seq"], num_partitions=partitions)
    want, final = one_after_another(games, rows, given)
    cols = ["seq", *[f"old_{x}" for x in g.columns], *[f"new_{x}" for x in g.columns], "reason"]
    assert sorted((tuple(r) for r in decisions.select(*cols).collect()), key=lambda t: t[0]) == want
    assert sorted(tuple(r) for r in snapshot.select(*g.columns).collect()) == sorted(final)
    assert rejected.count() == sum(w[-1] is not None for w in want)


def test_one_change_each_equals_the_single_form(spark):
    statuses = ["waiting", "active", "finished", None, "bogus"]
    games = [(i, 0, statuses[i % 5], D if i % 2 else None, None) for i in range(50)]
    g = spark.createDataFrame(games, GAMES)
    c = spark.createDataFrame([(i, statuses[(i // 5) % 5], 1) for i in range(50)], "game_id long, status string, seq int")
    s1, d1, _ = changes.apply_game_status(g, c.drop("seq"), NOW)
    s2, d2, _ = chains.apply_game_changes(g, c, NOW, ["seq"])
    assert sorted(map(str, s1.collect())) == sorted(map(str, s2.collect()))
    assert sorted(map(str, d1.select(*d1.columns).collect())) == sorted(map(str, d2.select(*d1.columns).collect()))


def test_reviews_in_turn_and_edges(spark):
    q = spark.createDataFrame([(1, "pending", None, None), (2, "approved", 5, D), (3, None, None, None)],
                              "question_id long, status string, checked_by_adminid long, check_date timestamp_ntz")
    rows = [(1, 1, "approved", None), (1, 2, "rejected", 4), (1, 3, "approved", None), (1, 4, "pending", None), (1, 5, "approved", None), (1, 6, "bogus", 9),
            (2, 1, "pending", None), (2, 2, "approved", 6), (3, 1, "approved", None), (None, 1, "approved", 1), (9, 1, "approved", 1)]
    c = spark.createDataFrame(rows, "question_id long, seq int, status string, checked_by_adminid long")
    snapshot, decisions, _ = chains.apply_question_reviews(q, c, NOW, ["seq"])
    got = [(r.old_question_id, r.seq, r.old_status, r.reason, r.new_check_date) for r in decisions.orderBy("old_question_id", "seq").collect()]
    assert got == [(1, 1, "pending", "admin_required", NOW), (1, 2, "pending", None, NOW), (1, 3, "rejected", None, NOW), (1, 4, "approved", None, NOW),
                   (1, 5, "pending", "admin_required", NOW), (1, 6, "pending", "domain", NOW), (2, 1, "approved", None, D), (2, 2, "pending", None, D), (3, 1, None, None, None)]
    assert sorted(tuple(r) for r in snapshot.collect()) == [(1, "pending", None, NOW), (2, "approved", 6, D), (3, "approved", None, None)]
    empty = chains.apply_question_reviews(q, c.limit(0), NOW, ["seq"])
    assert empty[1].collect() == [] and sorted(r.question_id for r in empty[0].collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        chains.apply_question_reviews(q, c, NOW, ["seq"], mode="fail")
