"""Column contracts: which columns a table must have, their role and their type.

A contract replaces the role-grouped column dictionary of a module. It is plain
data, checked against the header while the DataFrame is being built, and it
yields the ``StructType`` used for reading.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import types as T

# Roles
ID, DATE, TIME, CATEGORY, NUMBER, VOLUME, POPULATION, SEVERITY = (
    "id", "date", "time", "category", "number", "volume", "population", "severity")

_TYPES = {
    ID: T.StringType(), DATE: T.DateType(), TIME: T.TimestampNTZType(), CATEGORY: T.StringType(),
    NUMBER: T.DoubleType(), VOLUME: T.DoubleType(),
    POPULATION: T.BooleanType(), SEVERITY: T.BooleanType(),
}

# Adverse-event codes of the study protocol.
EVENT_CODES = (
    "1.1", "1.2", "1.3", "1.4", "1.5", "1.6",
    "2.1",
    "3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.7",
    "4.1", "4.2", "4.3",
    "5.1", "5.2",
    "6.1", "6.2",
    "7.1", "7.2", "7.3",
    "8.1",
    "9.1",
    "10.1", "10.2", "10.3", "10.4", "10.5", "10.6",
)
_HYPOTENSIVE = tuple(code for code in EVENT_CODES if code.startswith("1."))

# Cut points [a, b) with their labels.
AGE_BINS, AGE_LABELS = (18, 25, 40, 65, 1000), ("18-24", "25-39", "40-64", "65+")
BMI_BINS, BMI_LABELS = (0, 18.5, 25, 30, 1000), ("underweight", "normal", "overweight", "obese")
HCT_BINS, HCT_LABELS = (0, 36, 40, 45, 50, 100), ("0-36", "36-40", "41-45", "46-50", "50+")
QUARTILES = ("q1", "q2", "q3", "q4")

# Strptime directives used by the contracts and their Spark letters.
_SPARK_LETTERS = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}


def spark_pattern(strptime_format: str) -> str:
    """Spark datetime pattern of a strptime format; single letters also accept padding."""
    for directive, letters in _SPARK_LETTERS.items():
        strptime_format = strptime_format.replace(directive, letters)
    if "%" in strptime_format:
        raise ValueError(f"Unsupported date format directive in {strptime_format!r}.")
    return strptime_format


@dataclass(frozen=True)
class ColumnSpec:
    var: str                                   # name used by every query
    role: str
    name: str | None = None                    # header of the raw file
    fmt: str | None = None                     # strptime format of raw dates
    null_token: float | None = None            # value that stands for missing
    bins: tuple[float, ...] | int | None = None  # cut points, or number of quantile bins
    labels: tuple[str, ...] = ()
    binned_as: str | None = None               # output of the binning (default: var itself)
    codes: tuple[str, ...] = ()                # event codes of a severity group
    margin: float | None = None                # non-inferiority margin, percent

    @property
    def header(self) -> str:
        return self.name or self.var


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnSpec, ...]
    plan: int = 60_000                         # planned number of collections

    def of(self, *roles: str) -> list[ColumnSpec]:
        return [spec for spec in self.columns if spec.role in roles]

    def names(self, *roles: str) -> list[str]:
        return [spec.var for spec in (self.of(*roles) if roles else self.columns)]

    def spec(self, var: str) -> ColumnSpec:
        for spec in self.columns:
            if spec.var == var:
                return spec
        raise KeyError(f"Column {var} is not part of the contract.")

    def event_codes(self, severity: str, header: Iterable[str]) -> list[str]:
        """Event codes of a severity group that the table really has."""
        present = set(header)
        return [code for code in self.spec(severity).codes if code in present]

    def margin(self, severity: str) -> float:
        return float(self.spec(severity).margin or 0)

    def check(self, header: Sequence[str], raw: bool = False) -> None:
        """Every declared column present, none twice; else ``KeyError`` naming them."""
        wanted = [spec.header if raw else spec.var for spec in self.columns]
        absent = [name for name in wanted if name not in header]
        if absent:
            raise KeyError(f"The table lacks {', '.join(absent)}; add them or rename its columns.")
        twice = sorted({name for name in header if list(header).count(name) > 1})
        if twice:
            raise KeyError(f"The header repeats {', '.join(twice)}; keep one column of each name.")

    def struct(self, header: Sequence[str], raw: bool = False) -> T.StructType:
        """Schema in header order. Undeclared columns stay text and are pruned later.

        Raw files hold dates and Yes/No flags as text, so those are read as strings.
        """
        by_name = {spec.header if raw else spec.var: spec for spec in self.columns}
        codes = {code for spec in self.columns for code in spec.codes}
        fields = []
        for name in header:
            if name in by_name:
                dtype = _TYPES[by_name[name].role]
            else:
                dtype = T.BooleanType() if name in codes else T.StringType()
            if raw and not isinstance(dtype, T.DoubleType):
                dtype = T.StringType()
            fields.append(T.StructField(name, dtype))
        return T.StructType(fields)

    def selected(self, header: Sequence[str], raw: bool = False) -> list[str]:
        """Declared columns plus the event codes found in the header."""
        codes = [code for code in EVENT_CODES
                 if code in header and any(code in spec.codes for spec in self.columns)]
        return [spec.header if raw else spec.var for spec in self.columns] + codes


_DON = ColumnSpec("don_id", ID, "DONOR_NUMBER")
_COL = ColumnSpec("col_id", ID, "COLLECTION_NUMBER")
_DEV = ColumnSpec("dev_id", ID, "DEVICE_ID")
_SPLITS = (
    ColumnSpec("site", CATEGORY, "SITE_ID"),
    ColumnSpec("status", CATEGORY, "DONOR_SITE_STATUS"),
    ColumnSpec("group", CATEGORY, "GROUP"),
    ColumnSpec("gender", CATEGORY, "GENDER"),
)
_POPULATIONS = (
    ColumnSpec("itt", POPULATION, "ITT"),
    ColumnSpec("mitt", POPULATION, "MITT"),
    ColumnSpec("pp", POPULATION, "PP"),
)
_ALL = ColumnSpec("all_ae", SEVERITY, "ALL_AE_FL", codes=EVENT_CODES, margin=0)
_SIG = ColumnSpec("sig_hyp", SEVERITY, "SIG_HYP_FL", margin=.15,
                  codes=tuple(c for c in _HYPOTENSIVE if c != "1.1"))
_SEVERITIES = (
    _ALL,
    ColumnSpec("non_hyp", SEVERITY, "NON_HYP_FL", margin=0,
               codes=tuple(c for c in EVENT_CODES if c not in _HYPOTENSIVE)),
    ColumnSpec("hyp", SEVERITY, "HYP_FL", codes=_HYPOTENSIVE, margin=0),
    _SIG,
    ColumnSpec("only_1.1", SEVERITY, "ONLY_1.1_FL", codes=("1.1",), margin=0),
)
_AGE = ColumnSpec("age", NUMBER, "AGE", bins=AGE_BINS, labels=AGE_LABELS)
_BMI = ColumnSpec("bmi", NUMBER, "BMI_CALC", bins=BMI_BINS, labels=BMI_LABELS)
_WEIGHT = ColumnSpec("weight", NUMBER, "WEIGHT", bins=4, labels=QUARTILES)


def _volume(var: str, name: str | None = None, token: float | None = 0) -> ColumnSpec:
    return ColumnSpec(var, VOLUME, name, null_token=token)


_VOLUMES = (_volume("target_vol", "TARGET_VOLUME"), _volume("actual_vol", "ACTUAL_VOLUME"))
_DERIVED = (_volume("duration_minutes"), _volume("speed", token=None),
            _volume("yield", token=None), _volume("yield_resid", token=None))
_RAW_TIMES = (
    ColumnSpec("col_date", DATE, "DONATION_DATE", fmt="%m/%d/%Y"),
    ColumnSpec("proc_start", TIME, "PROCEDURE_START", fmt="%m/%d/%Y %H:%M"),
    ColumnSpec("proc_end", TIME, "PROCEDURE_END", fmt="%m/%d/%Y %H:%M"),
)
_TIMES = tuple(replace(spec, fmt="%Y-%m-%d" if spec.role == DATE else "%Y-%m-%d %H:%M:%S")
               for spec in _RAW_TIMES)


def _as_category(*specs: ColumnSpec) -> tuple[ColumnSpec, ...]:
    return tuple(replace(spec, role=CATEGORY, bins=None) for spec in specs)


def _binned_apart(spec: ColumnSpec) -> ColumnSpec:
    return replace(spec, binned_as=spec.var + "_cat")


# Raw tables, as exported by the study database.
RAW_SAFETY = Contract((_DON, _COL, _RAW_TIMES[0], *_SPLITS, _AGE, _BMI, _WEIGHT,
                       *_POPULATIONS, *_SEVERITIES))
RAW_PLASMA = Contract((_DON, _COL, _DEV, *_RAW_TIMES, *_VOLUMES, *_SPLITS, _AGE, _BMI,
                       replace(_WEIGHT, var="weight_cat"), *_POPULATIONS,
                       *(replace(spec, codes=()) for spec in _SEVERITIES)))
RAW_PROFILE = Contract((_DON, _COL, _DEV, *_RAW_TIMES, *_SPLITS,
                        *map(_binned_apart, (_AGE, _BMI, _WEIGHT)),
                        _volume("hct", "HEMATOCRIT"), *_VOLUMES, *_POPULATIONS, _ALL, _SIG))

# Analysis tables, as written by the preparation.
SAFETY = Contract((_DON, _COL, _TIMES[0], *_SPLITS, *_as_category(_AGE, _BMI, _WEIGHT),
                   *_POPULATIONS, *_SEVERITIES))
PLASMA = Contract((_DON, _COL, _DEV, *_TIMES, ColumnSpec("week", DATE, fmt="%Y-%m-%d"),
                   *_VOLUMES, *_DERIVED, *_SPLITS,
                   *_as_category(_AGE, _BMI, replace(_WEIGHT, var="weight_cat")),
                   *_POPULATIONS, *(replace(spec, codes=()) for spec in _SEVERITIES)))
PROFILE = Contract((_DON, _COL, _DEV, *_TIMES, *_SPLITS,
                    *(replace(spec, bins=None) for spec in (_AGE, _BMI, _WEIGHT)),
                    _volume("hct", "HEMATOCRIT"), *_VOLUMES, *_DERIVED,
                    *_POPULATIONS, _ALL, _SIG))
POWER = Contract((_COL, _TIMES[0], _SPLITS[2], *_SEVERITIES), plan=100_000)
ENROLMENT = Contract((ColumnSpec("ENR_DATE", TIME), ColumnSpec("SUBJECT_ID", ID),
                      ColumnSpec("SITE", CATEGORY), ColumnSpec("STRATA1", CATEGORY)))
VOLUMES = Contract((_TIMES[0], _SPLITS[2], ColumnSpec("weight", NUMBER),
                    ColumnSpec("height", NUMBER), ColumnSpec("hematocrit", NUMBER),
                    _volume("yield", token=None), _volume("actual_vol", token=None),
                    _volume("target_vol", token=None), *_POPULATIONS,
                    *(spec for spec in _SPLITS if spec.var != "group"),
                    *(ColumnSpec(var, CATEGORY) for var in ("age_cat", "weight_cat", "bmi_cat"))))
DASHBOARD = Contract((ColumnSpec("donor_id", ID), ColumnSpec("wd_fl", NUMBER),
                      *(ColumnSpec(var, CATEGORY) for var in (
                          "trt_group", "site", "gender", "donor_status",
                          "age_cat", "weight_cat", "bmi_cat", "hct_cat")),
                      _volume("target_volume", token=None), _volume("actual_volume", token=None),
                      _volume("yield", token=None)))
