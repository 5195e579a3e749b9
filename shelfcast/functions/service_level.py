"""z-score of a service level."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounded z-scores used by the retail rules.
Z_TABLE = {
    0.85: 1.036,
    0.90: 1.282,
    0.95: 1.645,
    0.97: 1.881,
    0.98: 2.054,
    0.99: 2.326,
    0.995: 2.576,
    0.999: 3.090,
}

# Coefficients of the published normal quantile approximation AS 241
# (Wichura 1988), highest power first.
_CENTRAL_NUM = (
    2.50908_09287_30122_6727e3, 3.34305_75583_58812_8105e4, 6.72657_70927_00870_0853e4,
    4.59219_53931_54987_1457e4, 1.37316_93765_50946_1125e4, 1.97159_09503_06551_4427e3,
    1.33141_66789_17843_7745e2, 3.38713_28727_96366_6080e0,
)
_CENTRAL_DEN = (
    5.22649_52788_52854_5610e3, 2.87290_85735_72194_2674e4, 3.93078_95800_09271_0610e4,
    2.12137_94301_58659_5867e4, 5.39419_60214_24751_1077e3, 6.87187_00749_20579_0830e2,
    4.23133_30701_60091_1252e1, 1.0,
)
_MIDDLE_NUM = (
    7.74545_01427_83414_07640e-4, 2.27238_44989_26918_45833e-2, 2.41780_72517_74506_11770e-1,
    1.27045_82524_52368_38258e0, 3.64784_83247_63204_60504e0, 5.76949_72214_60691_40550e0,
    4.63033_78461_56545_29590e0, 1.42343_71107_49683_57734e0,
)
_MIDDLE_DEN = (
    1.05075_00716_44416_84324e-9, 5.47593_80849_95344_94600e-4, 1.51986_66563_61645_71966e-2,
    1.48103_97642_74800_74590e-1, 6.89767_33498_51000_04550e-1, 1.67638_48301_83803_84940e0,
    2.05319_16266_37758_82187e0, 1.0,
)
_TAIL_NUM = (
    2.01033_43992_92288_13265e-7, 2.71155_55687_43487_57815e-5, 1.24266_09473_88078_43860e-3,
    2.65321_89526_57612_30930e-2, 2.96560_57182_85048_91230e-1, 1.78482_65399_17291_33580e0,
    5.46378_49111_64114_36990e0, 6.65790_46435_01103_77720e0,
)
_TAIL_DEN = (
    2.04426_31033_89939_78564e-15, 1.42151_17583_16445_88870e-7, 1.84631_83175_10054_68180e-5,
    7.86869_13114_56132_59100e-4, 1.48753_61290_85061_48525e-2, 1.36929_88092_27358_05310e-1,
    5.99832_20655_58879_37690e-1, 1.0,
)


def z_value(level: float) -> float:
    """z for one level known on the driver."""
    return Z_TABLE.get(level, NormalDist().inv_cdf(level))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF of a probability column in (0, 1)."""
    q = p - 0.5
    r_mid = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    mid, far = tail - 1.6, tail - 5.0
    central = q * _horner(_CENTRAL_NUM, r_mid) / _horner(_CENTRAL_DEN, r_mid)
    outer = F.when(
        tail <= 5.0, _horner(_MIDDLE_NUM, mid) / _horner(_MIDDLE_DEN, mid)
    ).otherwise(_horner(_TAIL_NUM, far) / _horner(_TAIL_DEN, far))
    return F.when(F.abs(q) <= 0.425, central).when(q < 0, -outer).otherwise(outer)


def z_score(level: Column) -> Column:
    """Tabulated z where the level is in the table, else the normal quantile."""
    tabulated = reduce(
        lambda acc, kv: acc.when(level == F.lit(kv[0]), F.lit(kv[1])),
        list(Z_TABLE.items())[1:],
        F.when(level == F.lit(0.85), F.lit(Z_TABLE[0.85])),
    )
    return tabulated.otherwise(normal_quantile(level))
