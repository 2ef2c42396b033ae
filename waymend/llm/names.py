"""Free names for the columns of tables whose names can be anything."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Inner:
    """A table under inner names c0, c1, ...: nothing clashes with what an operator adds, in whatever case it is written.

    replaced: names that the operator adds at the end; columns of these names, case aside, give way.
    """

    def __init__(self, df: DataFrame, replaced: Iterable[str] = ()):
        self.names = df.columns
        self.types = [f.dataType for f in df.schema.fields]
        self.df = df.toDF(*(f"c{k}" for k in range(len(self.names))))
        gone = {name.lower() for name in replaced}
        self.kept = [k for k, name in enumerate(self.names) if name.lower() not in gone]

    def at(self, name: str) -> str:
        """The inner name of a column: that of the very name, else of one that differs in case only."""
        exact = [k for k, n in enumerate(self.names) if n == name] or [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name} among {', '.join(self.names)}")
        return f"c{exact[0]}"

    def col(self, name: str) -> Column:
        return F.col(self.at(name))

    def schema(self, more: str) -> T.StructType:
        """All inner columns, and more."""
        return T.StructType([*(T.StructField(f"c{k}", kind) for k, kind in enumerate(self.types)), *T.StructType.fromDDL(more).fields])

    def outer(self) -> list[Column]:
        """The columns that stay, under their own names."""
        return [F.col(f"c{k}").alias(self.names[k]) for k in self.kept]


def literal(value, kind: T.DataType) -> Column:
    """A value of a row as a literal of its column's type, structs among them."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    return F.lit(value).cast(kind)


def ddl(kind: T.DataType) -> str:
    """A type as it is written in schemas, names of fields in quotes."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{ddl(kind.keyType)}, {ddl(kind.valueType)}>"
    return kind.simpleString()
