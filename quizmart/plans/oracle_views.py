"""DuckDB text of the stand-in views (FIXTURES.md §2), used to build oracle SQL as CTEs.

The driver pre-registers only the raw tables, so every oracle statement carries the views it
needs in a ``WITH`` clause. ``with_views`` resolves the dependencies between them.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_avatars": "SELECT n_nationkey AS avatar_id, n_name AS avatar_name FROM nation",
    "v_users": ("SELECT c_custkey AS user_id, c_name AS username, CAST(c_nationkey AS INT) AS avatar_id, "
                "c_mktsegment AS segment FROM customer"),
    "v_courses": "SELECT r_regionkey AS course_id, r_name AS course_name FROM region",
    "v_questions": (
        "SELECT d.doc_id AS question_id, CAST(d.doc_id % 4 AS INT) AS course_id, d.doc_id % 100 AS made_by_userid, "
        "CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.doc_id % 10 END AS checked_by_adminid, "
        "CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS status, "
        "d.text AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "v_answers": ("SELECT p_partkey AS answer_id, CAST(floor(p_partkey / 4) AS BIGINT) AS question_id, "
                  "p_name AS text, p_partkey % 4 = 0 AS right_wrong FROM part"),
    "v_games": (
        "SELECT o_orderkey AS game_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS course_id, "
        "o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'active' "
        "ELSE 'finished' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS start_date, "
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '15' MINUTE END AS finish_date FROM orders"),
    "v_game_answers": (
        "SELECT l.l_orderkey AS game_id, o.o_custkey AS user_id, l.l_partkey AS answer_id, "
        "l.l_linenumber AS round_no, l.l_returnflag = 'R' AS right_wrong, l.l_shipdate AS answered_at, "
        "l.l_suppkey AS tie1, l.l_extendedprice AS tie2, l.l_quantity AS tie3 "
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"),
    "v_game_rounds": ("SELECT DISTINCT l_linenumber + 10 * l_orderkey AS round_no, l_orderkey AS game_id, "
                      "CAST(floor(l_orderkey % 997 / 4) AS BIGINT) AS question_id FROM lineitem"),
    "v_game_groups": ("SELECT c_custkey AS game_id, c_custkey AS user_id, CAST(floor(c_acctbal) AS INT) AS score "
                      "FROM customer"),
    "v_chats": ("SELECT conv_id * 1000 + turn AS chat_id, conv_id AS game_id, role AS username, text, "
                "turn AS seq FROM conversations"),
    "v_events": (
        "SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'requestJoin' WHEN 'error' "
        "THEN 'disconnect' WHEN 'view' THEN 'page' WHEN 'click' THEN 'answer' ELSE 'chat-message' END AS kind, "
        "TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of every ``v_*`` view (and ``extra`` CTEs) it references.

    ``extra`` CTEs may reference views and each other (in insertion order).
    """
    extra = extra or {}
    needed: list[str] = []

    def visit(text: str):
        for name in _NAME.findall(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    for t in list(extra.values()) + [body]:
        visit(t)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in needed] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":  # merge the body's own CTE list into ours
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
