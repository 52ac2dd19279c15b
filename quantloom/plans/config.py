"""Configuration files: features by timeframe, classification of features, market and search."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

from ..operators.simulator import WEIGHTS, Market
from . import evolution
from .pipeline import Config

#: Sections and keys of mutations in configuration files, and ours.
MUTATION_KEYS = {
    "node_param_mutation": {"noise_ratio": "noise", "leverage_change": "leverage_step"},
    "add_node_mutation": {"max_add_nodes": "most_added"},
    "delete_node_mutation": {"max_delete_nodes": "most_deleted"},
    "add_subtree_mutation": {"node_count_range": "subtree_nodes"},
}


def read_config(path: str) -> dict:
    """A JSON or, where there is a YAML library, YAML file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise ValueError(f"{path}: no YAML library is installed; give the file as JSON") from missing
    return yaml.safe_load(text)


def feature_config(config: dict, timeframes: list[str] | None = None) -> Config:
    """The timeframes asked for, each function to its parameter sets; those the configuration lacks warn and are left out."""
    for tf in set(timeframes or ()) - set(config):
        warnings.warn(f"the configuration has no timeframe {tf}", stacklevel=2)
    found = {tf: {n: calls or [{}] for n, calls in config[tf].items()} for tf in timeframes or config if tf in config}
    if not found:
        raise ValueError("the configuration has none of the timeframes")
    return found


def classification_rules(config: dict) -> list[tuple]:
    """Rules (prefix, family, low, high) of a section with feature_num, feature_comparison_map or a list, and feature_bool."""
    named = {"bool": config.get("feature_bool") or [], "comparison": config.get("feature_comparison") or config.get("feature_comparison_map") or []}
    rules = [(str(p), family, None, None) for family, prefixes in named.items() for p in prefixes]
    return rules + [(str(p), "num", float(lo), float(hi)) for p, (lo, hi) in (config.get("feature_num") or {}).items()]


def market(config: dict) -> Market:
    env = config.get("simulation_env") or {}
    names = {"taker_fee_rate": "fee", "maintenance_margin_rate": "maintenance", "fixed_slippage_rate": "slippage", "min_additional_enter_ratio": "min_added", "max_additional_entries": "max_added"}
    return Market(**{ours: env[theirs] for theirs, ours in names.items() if theirs in env})


def search(config: dict, catalog: list[tuple]) -> evolution.Search:
    """A search by the sections environment, ga_core, operators and evaluation; what is missing keeps its default.

    The fitness weights are listed in the order of WEIGHTS."""
    core, ops, judged = config.get("ga_core") or {}, config.get("operators") or {}, config.get("evaluation") or {}
    sizes, loop = core.get("population") or {}, core.get("evolution_loop") or {}
    given = {
        "population": sizes.get("size"), "max_nodes": sizes.get("max_nodes"), "max_depth": sizes.get("max_depth"), "max_children": sizes.get("max_children"),
        "parents": loop.get("parent_pool_size"), "n_elites": loop.get("elite_size"), "pool_size": loop.get("best_chromosome_pool_size"), "warming": loop.get("warming_steps"),
        "seed": (config.get("environment") or {}).get("seed"), "minimum_trades": (judged.get("fitness_function") or {}).get("minimum_trades"),
    }
    kept = {k: v for k, v in given.items() if v is not None}
    selection = ops.get("selection") or {}
    if str(selection.get("type", "")).startswith("Tournament"):
        kept["tournament"] = selection.get("tournament_k_size", 5)
    if weights := (ops.get("crossover") or {}).get("weights"):
        kept["weights"] = tuple(weights)
    mutation = ops.get("mutation") or {}
    if rates := mutation.get("probabilities"):
        kept["rates"] = dict(rates)
    if listed := (judged.get("fitness_function") or {}).get("weights"):
        kept["fitness_weights"] = dict(zip(WEIGHTS, map(float, listed), strict=True))
    for section, names in MUTATION_KEYS.items():
        kept |= {ours: tuple(x) if isinstance(x, list) else x for theirs, ours in names.items() if (x := (mutation.get(section) or {}).get(theirs)) is not None}
    for section in sorted(set(mutation) - set(MUTATION_KEYS) - {"probabilities"}):
        warnings.warn(f"the configuration's mutation.{section} isn't known", stacklevel=2)
    return evolution.Search(catalog, market=market(judged), **kept)
