"""Element types of tensors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class EngineError(ValueError):
    """Base of every error of the engine; ``code`` names the case."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Dtype:
    name: str
    bits: int
    exponent: int | None
    mantissa: int | None
    program_id: int
    prior_id: int

    @property
    def bytes(self) -> int:
        return self.bits // 8

    @property
    def is_float(self) -> bool:
        return self.exponent is not None


# Fixed values of the formats: names, widths, float fields, ids in programs and archives, ids in priors.
DTYPES = {
    d.name: d
    for d in (
        Dtype("F16", 16, 5, 10, 0x01, 0), Dtype("BF16", 16, 8, 7, 0x02, 1), Dtype("F32", 32, 8, 23, 0x03, 2), Dtype("U8", 8, None, None, 0x04, 3), Dtype("U16", 16, None, None, 0x05, 4), Dtype("U32", 32, None, None, 0x06, 5),
        Dtype("I8", 8, None, None, 0x07, 6), Dtype("I16", 16, None, None, 0x08, 7), Dtype("I32", 32, None, None, 0x09, 8), Dtype("F8_E4M3", 8, 4, 3, 0x0A, 9), Dtype("F8_E5M2", 8, 5, 2, 0x0B, 10),
    )
}
BY_ID = {d.program_id: d for d in DTYPES.values()}


def dtype(name: str) -> Dtype:
    if name not in DTYPES:
        raise EngineError("UnsupportedDtype", name)
    return DTYPES[name]


def dtype_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.bits, d.exponent, d.mantissa, d.program_id, d.prior_id) for d in DTYPES.values()], "name string, bits int, exponent int, mantissa int, program_id int, prior_id int")


def numel(shape: list[int]) -> int:
    """Elements of a shape; any 0 makes it 0, and more than 2^63 - 1 is an error."""
    if 0 in shape:
        return 0
    out = 1
    for x in shape:
        out *= x
        if x < 0 or out >= 1 << 63:
            raise EngineError("ShapeOverflow", str(shape))
    return out
