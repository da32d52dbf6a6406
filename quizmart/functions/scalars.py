"""

Everything here returns a ``Column`` built from ``pyspark.sql.functions``: the expressions run
inside whole-stage codegen with the rest of the job. No Python UDFs.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that results must reproduce exactly (texts, labels, thresholds, defaults).
STATUS_LABELS = {"approved": "Angenommen", "rejected": "Abgelehnt"}
STATUS_LABEL_DEFAULT = "Ausstehend"
FEEDBACK_RIGHT = "✅ Richtig! Du hast eine Goldmünze verdient."
FEEDBACK_WRONG_PREFIX = "ℹ️ Hinweis: Die richtige Antwort ist "
FEEDBACK_WRONG_SUFFIX = "."
FEEDBACK_WRONG_GENERIC = "ℹ️ Hinweis: Die richtige Antwort ist die grün markierte Option."
MSG_FILL_ALL = "Bitte alle Felder ausfüllen!"
MSG_PASSWORD_5 = "Das Passwort muss mindestens 5 Zeichen haben!"
MSG_USERNAME_3 = "Der Benutzername muss mindestens 3 Zeichen haben!"
MSG_PROFILE_PASSWORD_8 = "Das Passwort muss mindestens 8 Zeichen lang sein."
MSG_PROFILE_MISMATCH = "Die Passwörter stimmen nicht überein."
MSG_PROFILE_USERNAME_3 = "Der Benutzername muss mindestens 3 Zeichen lang sein."
MSG_SUBMISSION = "Bitte alle Pflichtfelder ausfüllen und eine richtige Antwort markieren."
AVATAR_IDS = {"avatar2.jpeg": 32, "avatar3.jpeg": 33}
AVATAR_ID_DEFAULT = 31
AVATAR_FILE_DEFAULT = "avatar1.jpeg"
PLAYER_NAME_PREFIX = "Spieler"
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]
SIZE_UNITS = ["bytes", "kB", "MB", "GB", "TB", "PB"]
# ---------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def search_text(cols: Iterable, array_cols: Iterable = ()) -> Column:
    """The text a search runs over — fields joined with one space; a missing field is an
    empty string but keeps its separator; array elements are spread into the join."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]
    for a in array_cols:
        parts.append(F.array_join(F.transform(F.coalesce(_c(a), F.array().cast("array<string>")),
                                              lambda x: F.coalesce(x, F.lit(""))), " "))
    if len(parts) == 1:
        return parts[0]
    # array_join keeps empty strings (concat_ws would drop NULL, not '').
    return F.array_join(F.array(*parts), " ")


def search_match(cols: Iterable, term: str | None, array_cols: Iterable = ()) -> Column:
    """``trim(lower(term))`` is empty → everything; else case-insensitive substring match.

    Uses ``contains`` (no LIKE), so ``%`` and ``_`` in the term are ordinary characters.
    """
    t = (term or "").strip().lower()
    if not t:
        return F.lit(True)
    return F.lower(search_text(cols, array_cols)).contains(F.lit(t))


def filter_status(status_col, status: str | None) -> Column:
    """``'all'`` (or None) keeps every row, otherwise equality."""
    if status is None or status == "all":
        return F.lit(True)
    return _c(status_col) == F.lit(status)


def status_label(status_col) -> Column:
    """C4: approved → Angenommen, rejected → Abgelehnt, anything else incl. NULL → Ausstehend."""
    s = _c(status_col)
    return (F.when(s == "approved", STATUS_LABELS["approved"])
            .when(s == "rejected", STATUS_LABELS["rejected"]).otherwise(STATUS_LABEL_DEFAULT))


def format_date_de(col) -> Column:
    """ISO date/time text → ``dd.MM.yyyy``; text that is not a date is returned unchanged."""
    c = _c(col).cast("string")
    d = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")),
                   F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return F.coalesce(F.date_format(d, "dd.MM.yyyy"), c)


def escape_html(col, null_as: str | None = "") -> Column:
    """Replace ``&`` first, then ``< > " '``. ``null_as=''`` is the catalogue variant (falsy →
    ''), ``null_as='null'`` the admin pages' ``String(null)``."""
    c = _c(col).cast("string")
    for a, b in HTML_ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    if null_as is None:
        return c
    if null_as == "":
        return F.when(_c(col).isNull() | (_c(col).cast("string") == ""), F.lit("")).otherwise(c)
    return F.coalesce(c, F.lit(null_as))


def answer_label(pos) -> Column:
    """0 → A, 1 → B, …"""
    return F.char(F.lit(65) + _c(pos))


def moderation_actions(status_col) -> tuple[Column, Column]:
    """(can_approve, can_reject); a NULL status allows both."""
    s = _c(status_col)
    return ~s.eqNullSafe(F.lit("approved")), ~s.eqNullSafe(F.lit("rejected"))


def avatar_id_for_file(col) -> Column:
    """avatar2.jpeg → 32, avatar3.jpeg → 33, anything else → 31."""
    c = _c(col)
    e = F.lit(AVATAR_ID_DEFAULT)
    for f, i in reversed(list(AVATAR_IDS.items())):
        e = F.when(c == f, F.lit(i)).otherwise(e)
    return e


def avatar_file_from_url(col) -> Column:
    """Last path segment of the URL, percent-decoded; empty → avatar1.jpeg."""
    path = F.coalesce(F.try_parse_url(_c(col), F.lit("PATH")), F.lit(""))
    last = F.element_at(F.split(path, "/"), -1)
    decoded = F.coalesce(F.try_url_decode(last), last)
    return F.coalesce(F.nullif(decoded, F.lit("")), F.lit(AVATAR_FILE_DEFAULT))


def player_name(socket_id) -> Column:
    """C11: ``'Spieler' || first 4 characters of the socket id``."""
    return F.concat(F.lit(PLAYER_NAME_PREFIX), F.substring(_c(socket_id).cast("string"), 1, 4))


def answer_feedback(is_right, right_text) -> Column:
    """Feedback text for a given answer; ``right_text`` is the text of the right answer of
    the question (NULL/empty when the question has none)."""
    rt = F.trim(_c(right_text))
    return (F.when(_c(is_right), F.lit(FEEDBACK_RIGHT))
            .when(F.coalesce(rt, F.lit("")) != "",
                  F.concat(F.lit(FEEDBACK_WRONG_PREFIX), rt, F.lit(FEEDBACK_WRONG_SUFFIX)))
            .otherwise(F.lit(FEEDBACK_WRONG_GENERIC)))


def parse_int_or_zero(col) -> Column:
    """C14: JS ``parseInt(v, 10) || 0`` — leading (signed) integer after blanks, else 0."""
    digits = F.regexp_extract(_c(col).cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _nonempty(c) -> Column:
    return F.coalesce(F.trim(_c(c)), F.lit("")) != ""


def registration_rule(firstname, surname, username, email, password) -> Column:
    """First failing rule of the registration form (NULL when the form passes)."""
    fields = [firstname, surname, username, email, password]
    all_given = F.lit(True)
    for f in fields:
        all_given = all_given & _nonempty(f)
    pw, un = F.trim(_c(password)), F.trim(_c(username))
    return (F.when(~all_given, F.lit(MSG_FILL_ALL))
            .when(F.char_length(pw) < 5, F.lit(MSG_PASSWORD_5))
            .when(F.char_length(un) < 3, F.lit(MSG_USERNAME_3)))


def profile_rule(password, confirm, username) -> Column:
    """First failing rule of the profile form; an empty password means "unchanged"."""
    pw = F.coalesce(_c(password), F.lit(""))
    given = pw != ""
    return (F.when(given & (F.char_length(pw) < 8), F.lit(MSG_PROFILE_PASSWORD_8))
            .when(given & ~pw.eqNullSafe(F.coalesce(_c(confirm), F.lit(""))), F.lit(MSG_PROFILE_MISMATCH))
            .when(F.char_length(F.coalesce(_c(username), F.lit(""))) < 3, F.lit(MSG_PROFILE_USERNAME_3)))


def submission_rule(text, answers, correct, category, n_answers: int = 4) -> Column:
    """C17: the question form's check — trimmed text and category given, exactly ``n_answers``
    answers and all of them non-empty, a right index that names one of them. ``answers`` is
    ``array<string>``, ``correct`` the 0-based index; NULLs fail."""
    a = F.coalesce(_c(answers), F.array().cast("array<string>"))
    bad_answer = (F.size(a) != n_answers) | F.exists(a, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    bad_index = ~F.coalesce(_c(correct).between(0, n_answers - 1), F.lit(False))
    return F.when(~_nonempty(text) | bad_answer | bad_index | ~_nonempty(category), F.lit(MSG_SUBMISSION))


def submission_answers(answers, correct) -> Column:
    """C17: ``answers.map((a, i) => {text: trim(a), right_wrong: i == correct})``."""
    return F.transform(_c(answers), lambda x, i: F.struct(F.trim(x).alias("text"),
                                                         (i == _c(correct)).alias("right_wrong")))


SIZE_BYTES_LIMIT = 10 * 1024  # below: plain bytes
SIZE_HALF_LIMIT = 20 * 1024 - 1  # below, in half units: this unit


def size_pretty(nbytes) -> Column:
    """Human-readable size. Under 10240 bytes as they are; otherwise the value in half units
    (integer division, towards zero), moved up a unit while it has 20479 halves or more, and
    rounded half away from zero — e.g. 10239 → "10239 bytes", 10240 → "10 kB", 10485247 →
    "10239 kB", 10485248 → "10 MB". The last unit takes all larger values."""
    b = _c(nbytes).cast("bigint")
    size, sign = F.abs(b), F.when(b < 0, F.lit("-")).otherwise(F.lit(""))
    out = None
    for i in range(len(SIZE_UNITS) - 1, 0, -1):
        halves = F.shiftright(size, 10 * i - 1)
        text = F.concat(sign, F.shiftright(halves + 1, 1).cast("string"), F.lit(" " + SIZE_UNITS[i]))
        out = text if out is None else F.when(halves < SIZE_HALF_LIMIT, text).otherwise(out)
    return F.when(size < SIZE_BYTES_LIMIT, F.concat(b.cast("string"), F.lit(" " + SIZE_UNITS[0]))).otherwise(out)
