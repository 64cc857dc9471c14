"""Model inference over tables: providers by name, called on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from millrace.errors import Refused
from millrace.types import parse_type

#: provider name to a maker of predictors: options to a function from a frame of inputs to a frame of outputs.
PROVIDERS: dict[str, Callable[[dict[str, str]], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


@dataclass
class Model:
    name: str
    inputs: list[tuple[str, str]]
    outputs: list[tuple[str, str]]
    provider: str
    options: dict[str, str] = field(default_factory=dict)


def register_provider(name: str, make: Callable[[dict[str, str]], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    PROVIDERS[name.lower()] = make


def _http(options: dict[str, str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """POSTs a batch as JSON rows to `endpoint` and reads as many rows back."""

    def predict(inputs: pd.DataFrame) -> pd.DataFrame:
        import json
        from urllib.request import Request, urlopen

        request = Request(options["endpoint"], inputs.to_json(orient="records").encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=float(options.get("timeout_s", "30"))) as f:
            return pd.DataFrame(json.load(f))

    return predict


def _onnx(options: dict[str, str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Runs the model file at `path`; each input column feeds the model input of its name."""
    import numpy as np
    import onnxruntime

    session = onnxruntime.InferenceSession(options["path"])

    def predict(inputs: pd.DataFrame) -> pd.DataFrame:
        feed = {i.name: np.stack([np.atleast_1d(v) for v in inputs[i.name]]).astype(np.float32) for i in session.get_inputs()}
        return pd.DataFrame({o.name: list(np.asarray(v)) for o, v in zip(session.get_outputs(), session.run(None, feed), strict=True)})

    return predict


register_provider("http", _http)
register_provider("onnx", _onnx)


def predict(df: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """ML_PREDICT: the input's columns and the model's outputs; `columns` feed the model's inputs in order.

    A predictor is made once in each task and called for each batch of rows.
    """
    if len(columns) != len(model.inputs):
        raise Refused(f"model {model.name} takes {len(model.inputs)} inputs")
    if model.provider.lower() not in PROVIDERS:
        raise Refused(f"unknown model provider {model.provider}")
    make, options = PROVIDERS[model.provider.lower()], dict(model.options)
    names, outputs = [n for n, _ in model.inputs], [n for n, _ in model.outputs]
    if clash := set(outputs) & set(df.columns):
        raise Refused(f"model outputs are columns of the input: {', '.join(sorted(clash))}")
    schema = StructType(df.schema.fields[:])
    for n, kind in model.outputs:
        schema = schema.add(n, parse_type(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f: Any = make(options)
        for b in batches:
            got = f(b[columns].set_axis(names, axis=1))
            yield b.assign(**{n: got[n].to_numpy() for n in outputs})

    return df.mapInPandas(run, schema)
