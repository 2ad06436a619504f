"""XPath over XML text. The ``try_`` forms give NULL for text that is no XML, which the others fail on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column


def _over(fn: Callable[[Column, Column], Column]) -> Callable[[Column | str, str], Column]:
    return lambda c, path: fn(column(c), F.lit(path))


xpath, xpath_string, xpath_boolean = _over(F.xpath), _over(F.xpath_string), _over(F.xpath_boolean)
xpath_short, xpath_int, xpath_long = _over(F.xpath_short), _over(F.xpath_int), _over(F.xpath_long)
xpath_float, xpath_double = _over(F.xpath_float), _over(F.xpath_double)
xpath_number = xpath_double


def well_formed(c) -> Column:
    """Whether text is XML; Spark has no function that tells, so Arrow batches go to Python's expat."""

    def parses(text: str | None) -> bool:  # in here, so that it goes to the workers with the function
        from xml.parsers import expat

        if not text:
            return False
        try:
            expat.ParserCreate().Parse(text.encode(), True)
        except expat.ExpatError:
            return False
        return True

    @F.pandas_udf("boolean")
    def check(text: pd.Series) -> pd.Series:
        return text.map(parses).astype(bool)

    return check(column(c))


def _try(fn: Callable[[Column | str, str], Column]) -> Callable[[Column | str, str], Column]:
    return lambda c, path: fn(F.when(well_formed(c), column(c)), path)


try_xpath, try_xpath_string, try_xpath_boolean = _try(xpath), _try(xpath_string), _try(xpath_boolean)
try_xpath_short, try_xpath_int, try_xpath_long = _try(xpath_short), _try(xpath_int), _try(xpath_long)
try_xpath_float, try_xpath_double = _try(xpath_float), _try(xpath_double)
try_xpath_number = try_xpath_double
