"""Field facts: what a table's file header says about a field, carried in the metadata of its StructField."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INDEX, DELETED = "_physical_index", "_deleted"
KEEP, PSEUDONYMIZE, MASKED, SHIFT = "KEEP", "PSEUDONYMIZE_REVERSIBLE", "MASK_REVERSIBLE", "SHIFT_REVERSIBLE"
SYSTEM, UNSAFE = "SYSTEM", "UNSAFE"

#: Logical class, default action, policy section and key, binary and untranslated flags allowed.
TYPE_MATRIX = {
    "C": ("TEXT", PSEUDONYMIZE, ("text", "default_action"), False, False),
    "V": ("TEXT", PSEUDONYMIZE, ("text", "default_action"), False, False),
    "M": ("MEMO_TEXT_OR_BINARY_PAYLOAD", MASKED, ("memo", "text"), False, False),
    "G": ("BINARY_MEMO", MASKED, ("memo", "binary"), True, True),
    "P": ("BINARY_MEMO", MASKED, ("memo", "binary"), True, True),
    "D": ("DATE", SHIFT, ("temporal", "date"), False, True),
    "T": ("DATETIME", SHIFT, ("temporal", "datetime"), False, True),
    **{k: ("SCALAR_IDENTITY", KEEP, None, False, True) for k in "NFIYBL"},
}


@dataclass(frozen=True)
class FieldFact:
    name: str
    dbf_type: str
    width: int
    decimals: int = 0
    encoding: str = "utf-8"
    nullable: bool = True
    binary: bool = False
    system: bool = False
    nocptrans: bool = False


@dataclass(frozen=True)
class Table:
    """path: posix path relative to the dataset. df has the hidden columns of position and deletion."""

    path: str
    df: DataFrame
    facts: tuple[FieldFact, ...]

    @property
    def fields(self) -> dict[str, FieldFact]:
        return {f.name: f for f in self.facts}

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)


@dataclass(frozen=True)
class Dataset:
    tables: dict[str, Table] = field(default_factory=dict)

    def __iter__(self):
        return iter(self.tables[p] for p in sorted(self.tables))


def spark_type(fact: FieldFact) -> T.DataType:
    if fact.dbf_type == "N":
        return T.DecimalType(fact.width, 0) if not fact.decimals else T.DoubleType()
    return {
        "C": T.StringType(), "V": T.StringType(), "M": T.StringType(), "G": T.BinaryType(), "P": T.BinaryType(), "D": T.DateType(),
        "T": T.TimestampNTZType(), "F": T.DoubleType(), "B": T.DoubleType(), "Y": T.DecimalType(19, 4), "I": T.IntegerType(), "L": T.BooleanType(),
    }[fact.dbf_type]


def guess_fact(column: T.StructField) -> FieldFact:
    """The fact of a Parquet column that carries no header of its own: never narrower than its type."""
    kind = column.dataType
    simple = kind.simpleString()
    if simple == "string":
        code, width, decimals = "C", 254, 0
    elif simple == "binary":
        code, width, decimals = "G", 10, 0
    elif simple == "date":
        code, width, decimals = "D", 8, 0
    elif simple.startswith("timestamp"):
        code, width, decimals = "T", 8, 0
    elif simple == "boolean":
        code, width, decimals = "L", 1, 0
    elif simple in ("int", "smallint", "tinyint"):
        code, width, decimals = "I", 4, 0
    elif simple == "bigint":
        code, width, decimals = "N", 18, 0
    elif isinstance(kind, T.DecimalType):
        code, width, decimals = "N", kind.precision, kind.scale
    elif simple in ("double", "float"):
        code, width, decimals = "B", 8, 8
    else:
        code, width, decimals = "Q", 0, 0  # nested types have no place in a record; policy refuses them
    return FieldFact(column.name, code, width, decimals, "utf-8" if code in "CVM" else "none", column.nullable)


def read_facts(schema: T.StructType, given: dict[str, FieldFact] | None = None) -> tuple[FieldFact, ...]:
    """Facts by column: given ones first, then those in the metadata, then a guess."""
    out = []
    for column in schema:
        if column.name in (INDEX, DELETED):
            continue
        if given and column.name in given:
            out.append(given[column.name])
        elif "fact" in column.metadata:
            out.append(FieldFact(**column.metadata["fact"]))
        else:
            out.append(guess_fact(column))
    return tuple(out)


def with_facts(df: DataFrame, facts: tuple[FieldFact, ...]) -> DataFrame:
    for fact in facts:
        df = df.withMetadata(fact.name, {"fact": asdict(fact)})
    return df


def standalone(fact: FieldFact) -> FieldFact:
    """The fact in a fresh table: system flags and bindings stay behind."""
    return replace(fact, system=False)


def classify_field(fact: FieldFact, policy: dict) -> str:
    """The action for a field, SYSTEM for what the writer manages, UNSAFE for what must be refused."""
    if fact.system or fact.dbf_type == "0":
        return SYSTEM if fact.dbf_type == "0" and fact.name == "_NULLFLAGS" else UNSAFE
    rule = TYPE_MATRIX.get(fact.dbf_type)
    if rule is None or (fact.binary and not rule[3]) or (fact.nocptrans and not rule[4]):
        return UNSAFE
    if rule[2] is None:
        return rule[1]
    section, key = rule[2]
    return policy[section][key]
