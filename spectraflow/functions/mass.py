"""Mass arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masses of ions in Da.
PROTON = 1.00727646688
POSITIVE_ADDUCTS = {"M+H": 0.0, "M+Na": 21.9820, "M+K": 37.955882, "M+NH4": 17.02655}
NEGATIVE_ADDUCTS = {"M-H": 0.0, "M+Cl": 35.976678, "M-H2O-H": -18.0106}
ISOTOPE_DIFFERENCES = {"13C": 1.003355, "Na/H": 21.9820}


def tolerance(mz: Column, ppm: float) -> Column:
    return mz * (ppm * 1e-6)


def ppm_error(mz: Column, reference: Column) -> Column:
    return (mz - reference) / reference * 1e6


def ions(neutral_mass: Column, mode: str = "pos", adducts: bool = True) -> Column:
    """Array of (label, mz) of a neutral mass's ions; adducts are relative to the base ion."""
    base = neutral_mass + (PROTON if mode == "pos" else -PROTON)
    table = POSITIVE_ADDUCTS if mode == "pos" else NEGATIVE_ADDUCTS
    chosen = table if adducts else dict([next(iter(table.items()))])
    return F.array(*[F.struct(F.lit(k).alias("ion"), (base + d).alias("ion_mz")) for k, d in chosen.items()])
