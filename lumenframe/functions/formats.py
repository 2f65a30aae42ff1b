"""Number formats that only Python gives digit for digit, as Arrow functions for sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _formatter(say):
    @F.arrow_udf(StringType())
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else say(v) for v in values.to_pylist()], pa.string())

    return text


#: Six decimals, as label files have them.
fixed6 = _formatter("{:.6f}".format)
#: Six digits at most, without trailing zeros.
general = _formatter(lambda v: "%g" % v)
#: The shortest text that reads back the same.
shortest = _formatter(repr)
#: Two decimals, for label captions.
fixed2 = _formatter("{:.2f}".format)
