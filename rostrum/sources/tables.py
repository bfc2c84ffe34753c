"""Page readers as table functions, for SQL and lateral joins.

``register(spark)`` names them; a lateral join then keeps whatever other columns
the pages have, which the ``DataFrame`` readers in ``markup`` drop:

    SELECT p.*, c.title FROM pages p, LATERAL result_cards(p.layout, p.html) c

Rows of a call are those of the reader of the same name, without its key column.
A page that is null gives what the reader gives for an empty one.  The functions
take rows one by one: as Arrow ones they would make a frame for each page.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from rostrum.sources import markup

NAMES = ("result_cards", "registry_cells", "people_card_parts")


@udtf(returnType=markup.RESULT_CARD, useArrow=False)
class ResultCards:
    """SRC7: hits of a saved result page, or one row with its status."""

    def eval(self, layout: str, html: str):
        yield from markup.result_card_rows(layout or "", html or "")


@udtf(returnType=markup.REGISTRY_CELLS, useArrow=False)
class RegistryCells:
    """SRC11, markup half: the table rows of a registry page."""

    def eval(self, html: str):
        yield from markup.registry_cell_rows(html or "")


@udtf(returnType=markup.PEOPLE_CARD, useArrow=False)
class PeopleCardParts:
    """SRC14, markup half: one row per outermost card."""

    def eval(self, html: str):
        yield from markup.people_card_rows(html or "")


def register(spark: SparkSession) -> None:
    for name, function in zip(NAMES, (ResultCards, RegistryCells, PeopleCardParts)):
        spark.udtf.register(name, function)


def beside(pages: DataFrame, call: str, columns: str = "t.*") -> DataFrame:
    """``pages`` with the rows of a table function beside each: all columns of the
    page stay, and a page without rows goes.  ``call`` is written over ``p``, e.g.
    ``registry_cells(p.html)``; ``columns`` picks from its rows ``t``.  Clashing
    names are the caller's to alias (``t.status AS card_status``)."""
    register(pages.sparkSession)
    return pages.sparkSession.sql(f"SELECT p.*, {columns} FROM {{pages}} p, LATERAL {call} t", pages=pages)
