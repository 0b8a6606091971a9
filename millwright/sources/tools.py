"""The operators as named tools: plain JSON in, plain JSON out, files confined to one folder."""

from __future__ import annotations

from collections.abc import Callable

from millwright.functions.report import to_jsonable
from millwright.operators import drift, profile, quality, reliability, spc
from millwright.sources.files import resolve_csv


def _over_file(root: str, f: Callable) -> Callable[..., dict]:
    def run(path: str, **arguments) -> dict:
        df, error = resolve_csv(path, root)
        try:
            return error or to_jsonable(f(df, **arguments))
        except Exception as e:  # a tool answers, whatever happens
            return {"error": f"{type(e).__name__}: {e}"}

    return run


def create_tools(root: str) -> dict[str, Callable[..., dict]]:
    """Seven tools over CSV files below ``root``; each returns a report or {"error": ...} and never raises."""

    def over_file(f: Callable) -> Callable[..., dict]:
        return _over_file(root, f)

    def analyze(df, target: str, **options) -> dict:
        from millwright.ml.analysis import auto_analyze

        return auto_analyze(df, target, **options)

    return {
        "inspect_dataset": over_file(lambda df, target: profile.inspect_data(df, target)),
        "audit_dataset": over_file(lambda df, target=None: profile.audit_data_quality(df, target)),
        "analyze_dataset": over_file(analyze),
        "control_chart": over_file(lambda df, value, order_by, chart="ewma", **k: (spc.calculate_cusum_chart if chart == "cusum" else spc.calculate_ewma_chart)(df, value, order_by, **k)),
        "process_capability": over_file(lambda df, value, order_by, **k: quality.calculate_capability(df, value, order_by, **k)),
        "pareto": over_file(lambda df, category, value=None, **k: reliability.calculate_pareto(df, category, value, **k)),
        "repair_times": over_file(lambda df, **k: reliability.calculate_mttr(df, **k)),
    }


def create_plant_tools(root: str) -> dict[str, Callable[..., dict]]:
    """Three more tools: drift of each asset between two CSV files below ``root``, and savings and OEE of plain numbers."""

    def over_numbers(f: Callable) -> Callable[..., dict]:
        def run(**arguments) -> dict:
            try:
                return to_jsonable(f(**arguments))
            except Exception as e:
                return {"error": f"{type(e).__name__}: {e}"}

        return run

    def asset_drift(train_path: str, path: str, asset: str, **options) -> dict:
        train, error = resolve_csv(train_path, root)
        return error or _over_file(root, lambda batch: drift.check_asset_drift(train, batch, asset, **options))(path)

    return {
        "check_asset_drift": asset_drift,
        "calculate_maintenance_savings": over_numbers(reliability.calculate_maintenance_savings),
        "calculate_oee": over_numbers(reliability.calculate_oee),
    }
