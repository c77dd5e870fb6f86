"""How an output came about: software and the command, in forms that headers can hold."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFTWARE = "gridloom"
#: What can't stand in a header: braces end a field, line ends a line.
_UNFIT, _FIT = "{}\n\r", "()  "


@dataclass(frozen=True)
class Provenance:
    software: str = ""
    command: str = ""


def quoted(arg: str) -> str:
    """An argument for a header's command line: fit for it, and in single quotes if it is empty or holds white space or quotes."""
    arg = arg.translate(str.maketrans(_UNFIT, _FIT))
    return arg if re.fullmatch(r"[^\s'\"]+", arg) else "'" + arg.replace("'", "'\\''") + "'"


def of_arguments(args: list[str], software: str = SOFTWARE) -> Provenance:
    return Provenance(software, " ".join(map(quoted, args)))


def quoted_col(arg: Column) -> Column:
    """:func:`quoted` of a column."""
    fit = F.translate(arg, _UNFIT, _FIT)
    inner = F.replace(fit, F.lit("'"), F.lit("'\\''"))
    return F.when(fit.rlike("(?U)^[^\\s'\"]+$"), fit).otherwise(F.concat(F.lit("'"), inner, F.lit("'")))
