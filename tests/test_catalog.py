"""A sample of catalog queries against DuckDB, and the shape of the driver contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, connect  # noqa: E402

from barline.catalog.all import load  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_bars_zscore_asof", "s13_append_dedup", "p12_quantile_gate", "b02_resample_anchored", "b05_volume_bars", "j01_asof",
    "j16_interval_overlap", "a10_grid_mean", "o03_top_bottom", "w05_ema_wilder_first", "w11_mad_zscore", "ind_adx", "ind_smi",
    "f10_two_bar_shape", "e10_first_passage", "x07_transition_signal", "t02_newey_west", "l16_floating_equity", "g03_tumbling_bars", "g13_kernel_parity",
]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def test_contract_needs_no_session():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 300


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    status, _, _, message = compare(load()[name], spark, connect(SF), SF)
    assert status in ("ok", "rows"), message
