"""Plans of explanations: which method explains which model against which background, as plain operator settings that a
backend runs. Nothing is computed here."""

from __future__ import annotations

#: Fixed: methods and the names that they are also known by.
METHODS = {"shap": "explain.shap", "kernel_shap": "explain.kernel_shap", "tree_shap": "explain.tree_shap", "lime": "explain.lime", "permutation": "explain.permutation", "permutation_importance": "explain.permutation", "pdp": "explain.pdp", "ice": "explain.ice"}
DEFAULT_BACKGROUND = {"strategy": "random", "k": 50}


class ExplainError(ValueError):
    pass


def method(name: str) -> str:
    key = name.lower().removeprefix("explain.")
    return METHODS.get(key, f"explain.{key}")


def background(given) -> dict:
    """``strategy`` and ``k`` from a number, a size, a number of clusters, or such a pair."""
    if isinstance(given, int) and not isinstance(given, bool):
        return {**DEFAULT_BACKGROUND, "k": given}
    if not isinstance(given, dict):
        return dict(DEFAULT_BACKGROUND)
    rest = {k: v for k, v in given.items() if k not in ("size", "kmeans_k")}
    if "size" in given:
        rest.setdefault("k", int(given["size"]))
    if "kmeans_k" in given:
        rest.setdefault("strategy", "kmeans")
        rest.setdefault("k", int(given["kmeans_k"]))
    return {**DEFAULT_BACKGROUND, **rest}


def explanation_plan(settings: dict) -> dict:
    """``ops`` (method, model, background and what else a method takes), ``target``, ``sequence`` and ``scaling``.
    ``settings`` has ``ops``, or ``explainers`` with a name and parameters each; a model named for all goes to those
    that name none."""
    entries = settings.get("ops") or [{"op": x.get("name"), **x.get("params", {})} for x in settings.get("explainers", [])]
    model, out = settings.get("model_ref") or (settings["model"] if isinstance(settings.get("model"), str) else None), []
    for entry in entries:
        op = {k: v for k, v in entry.items() if k not in ("op", "name", "background", "background_size", "kmeans_k")}
        name = entry.get("op") or entry.get("name")
        if not name:
            raise ExplainError("an explanation needs a method")
        found = {"op": method(name), **op}
        if model:
            found.setdefault("model_ref", model)
        if settings.get("device"):
            found.setdefault("device", settings["device"])
        if "background" in entry:
            found["background"] = background(entry["background"])
        elif "background_size" in entry:
            found["background"] = background(int(entry["background_size"]))
        elif "kmeans_k" in entry:
            found["background"] = background({"kmeans_k": entry["kmeans_k"]})
        out.append(found)
    return {"ops": out, **{k: settings.get(k) for k in ("target", "sequence", "scaling")}}
