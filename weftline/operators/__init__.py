"""All operators by name."""

from weftline.operators.aggregation import GroupBy
from weftline.operators.base import LazyWrapper, Transformer, is_lazy_reference, resolve_lazy
from weftline.operators.checks import AssertContainsColumns, AssertCount, AssertNotEmpty, CpuInfo, LogDataSkew, PrintSchema
from weftline.operators.combining import AppendDataFrame, Join, append_dataframes, join_dataframes
from weftline.operators.filtering import DropNulls, Filter
from weftline.operators.frames import Cache, CoalescePartitions, DataFrameMethod, Persist, Repartition, SparkDropDuplicates
from weftline.operators.projection import (
    AddLiterals,
    Cast,
    ColumnsToMap,
    DropColumns,
    HorizontalFunction,
    MapToColumns,
    MathOperator,
    RenameColumns,
    SelectColumns,
    SparkColumnMethod,
    SparkSqlFunction,
    When,
    WithColumns,
)
from weftline.operators.reshaping import Pivot, SparkExplode, Unpivot
from weftline.operators.window import AggregateOverWindow, LagOverWindow

__all__ = [
    "AddLiterals", "AggregateOverWindow", "AppendDataFrame", "AssertContainsColumns", "AssertCount", "AssertNotEmpty", "Cache", "Cast",
    "CoalescePartitions", "ColumnsToMap", "CpuInfo", "DataFrameMethod", "DropColumns", "DropNulls", "Filter", "GroupBy", "HorizontalFunction",
    "Join", "LagOverWindow", "LazyWrapper", "LogDataSkew", "MapToColumns", "MathOperator", "Persist", "Pivot", "PrintSchema", "RenameColumns", "Repartition",
    "SelectColumns", "SparkColumnMethod", "SparkDropDuplicates", "SparkExplode", "SparkSqlFunction", "Transformer", "Unpivot", "When", "WithColumns",
    "append_dataframes", "is_lazy_reference", "join_dataframes", "resolve_lazy",
]
