"""Arrow functions over columns, declared by their Arrow result type (no session is needed to import them)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def arrow_function(kind: pa.DataType):
    return F.arrow_udf(from_arrow_type(kind))
