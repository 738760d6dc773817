"""Recorded ``/proc/<pid>/syscall`` lines as short texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is said of a call. Numbers in braces are arguments: plain unsigned, ``i`` signed, ``x`` hexadecimal;
#: a second form, if there is one, holds where the signed argument named by the third value is below nought (``<``) or is nought (``=``).
FORMS = {
    61: ("wait4(pid={0i})",),
    247: ("waitid(id={1i})",),
    7: ("poll(nfds={1}, timeout={2i}ms)", "poll(nfds={1}, timeout=∞)", "<2"),
    271: ("ppoll(nfds={1})", "ppoll(nfds={1}, timeout=∞)", "=2"),
    23: ("select(nfds={0})",),
    270: ("pselect6(nfds={0})", "pselect6(nfds={0}, timeout=∞)", "=4"),
    232: ("epoll_wait(timeout={3i}ms)", "epoll_wait(timeout=∞)", "<3"),
    281: ("epoll_wait(timeout={3i}ms)", "epoll_wait(timeout=∞)", "<3"),
    441: ("epoll_wait(timeout={3i}ms)", "epoll_wait(timeout=∞)", "<3"),
    202: ("futex(op=0x{1x})",),
    0: ("read(fd={0})",),
    35: ("nanosleep",),
    230: ("nanosleep",),
}
LARGEST = "18446744073709551615"


def hex_digits(word: Column) -> Column:
    """A word's hexadecimal digits without ``0x`` and leading noughts, in capitals; null where it is no number of 64 bits."""
    bare = F.regexp_replace(word, r"^(0x)*\+?", "")
    digits = F.regexp_replace(F.upper(bare), r"^0+(?=.)", "")
    return F.when(bare.rlike(r"^[0-9A-Fa-f]+\z") & (F.length(digits) <= 16), digits)


def number(word: Column) -> Column:
    """A call's number, decimal or else hexadecimal, as decimal digits."""
    plain = F.regexp_replace(F.regexp_replace(word, r"^\+", ""), r"^0+(?=.)", "")
    fits = word.rlike(r"^\+?[0-9]+\z") & ((F.length(plain) < 20) | ((F.length(plain) == 20) & (plain <= LARGEST)))
    return F.when(fits, plain).otherwise(F.coalesce(F.conv(hex_digits(word), 16, 10), F.lit(LARGEST)))


def filled(form: str) -> Column:
    """A form with its arguments, from columns ``_a0`` and so on, put in."""
    parts = []
    for i, text in enumerate(form.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(text))
            continue
        digits, kind = F.col(f"_a{text[0]}"), text[1:]
        parts.append(F.lower(digits) if kind == "x" else F.conv(digits, 16, -10 if kind == "i" else 10))
    return F.concat(*parts)


def holds(when: str) -> Column:
    digits = F.col(f"_a{when[1]}")
    # Below nought: all 16 digits, the first of them 8 or more.
    return (F.length(digits) == 16) & (F.substring(digits, 1, 1) >= "8") if when[0] == "<" else digits == "0"


def with_decoded(rows: DataFrame, line: str, name: str) -> DataFrame:
    """``rows`` with what a recorded line says: the call with its telling arguments, ``syscall#N`` for others, ``running`` for none; null is none too.

    Words, number and arguments are columns of their own for a while, so each
    is worked out once a row, not once a form. An argument that is missing or
    no number of 64 bits is nought.
    """
    kept = rows.columns
    raw = F.coalesce(F.col(line), F.lit(""))
    rows = rows.withColumn("_raw", raw).withColumn("_words", F.filter(F.split("_raw", r"[ \t\n\f\r]+"), lambda w: w != ""))
    digits = {f"_a{n}": F.coalesce(hex_digits(F.get("_words", F.lit(n + 1))), F.lit("0")) for n in range(5)}
    rows = rows.withColumns({"_nr": number(F.get("_words", F.lit(0))), **digits})
    out = F.concat(F.lit("syscall#"), F.col("_nr"))
    for call, (form, *other) in FORMS.items():
        said = F.when(holds(other[1]), filled(other[0])).otherwise(filled(form)) if other else filled(form)
        out = F.when(F.col("_nr") == str(call), said).otherwise(out)
    said = F.when(F.col("_raw").isin("", "running"), F.lit("running")).when(F.size("_words") == 0, F.col("_raw")).otherwise(out)
    return rows.withColumn(name, said).select(*kept, name)
