"""Fitted models in files: an envelope with a magic word, a version, the payload's length and its CRC-32.

Payloads are JSON for models of numbers (linear forms, class scores' settings), pickles of this package's classes for the
rest; a pickle is only opened if it names classes of this package, numpy and Python's own containers.
"""

from __future__ import annotations

import io
import json
import pickle
import struct
import zlib
from pathlib import Path
from xml.sax.saxutils import quoteattr

import numpy as np

from tessera.errors import InvalidParameter
from tessera.operators.linear import LinearModel, LogisticModel

MAGIC, VERSION = b"TSRM", 1
_HEAD = struct.Struct("<4sHQI")
_JSON = {"LinearModel": LinearModel, "LogisticModel": LogisticModel}


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if module.split(".")[0] in ("tessera", "numpy") or (module, name) in {("builtins", n) for n in ("list", "dict", "set", "tuple", "frozenset", "slice", "range", "complex")}:
            return super().find_class(module, name)
        raise InvalidParameter(f"a model file must not name {module}.{name}")


def save_model_bytes(model) -> bytes:
    payload = pickle.dumps(model, protocol=5)
    return _HEAD.pack(MAGIC, VERSION, len(payload), zlib.crc32(payload)) + payload


def load_model_bytes(data: bytes):
    if len(data) < _HEAD.size:
        raise InvalidParameter("not a model file")
    magic, version, size, crc = _HEAD.unpack_from(data)
    payload = data[_HEAD.size :]
    if magic != MAGIC or version != VERSION:
        raise InvalidParameter("not a model file of this version")
    if len(payload) != size or zlib.crc32(payload) != crc:
        raise InvalidParameter("the model file is damaged")
    return _Reader(io.BytesIO(payload)).load()


def save_model(model, path: str) -> None:
    Path(path).write_bytes(save_model_bytes(model))


def load_model(path: str):
    return load_model_bytes(Path(path).read_bytes())


def save_model_json(model: LinearModel) -> str:
    """A linear or logistic model as JSON, with its CRC-32."""
    kind = type(model).__name__
    if kind not in _JSON:
        raise InvalidParameter("only linear and logistic models have a JSON form")
    body = {"kind": kind, "columns": model.columns, "coefficients": [float(b) for b in model.coefficients], "intercept": model.intercept, "output": model.output}
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"version": VERSION, "crc32": zlib.crc32(text.encode()), "model": body}, sort_keys=True)


def load_model_json(text: str) -> LinearModel:
    found = json.loads(text)
    body = found["model"]
    if zlib.crc32(json.dumps(body, sort_keys=True).encode()) != found["crc32"]:
        raise InvalidParameter("the model is damaged")
    return _JSON[body["kind"]](body["columns"], np.array(body["coefficients"]), body["intercept"], body["output"])


def save_pmml(model: LinearModel, path: str | None = None) -> str:
    """A linear or logistic model as PMML 4.4."""
    fields = "".join(f'<DataField name={quoteattr(c)} optype="continuous" dataType="double"/>' for c in model.columns)
    mining = "".join(f"<MiningField name={quoteattr(c)}/>" for c in model.columns)
    terms = "".join(f"<NumericPredictor name={quoteattr(c)} coefficient={quoteattr(repr(float(b)))}/>" for c, b in zip(model.columns, model.coefficients, strict=True))
    link = ' normalizationMethod="logit"' if isinstance(model, LogisticModel) else ""
    text = (
        '<?xml version="1.0" encoding="UTF-8"?><PMML xmlns="http://www.dmg.org/PMML-4_4" version="4.4"><Header/>'
        f'<DataDictionary numberOfFields="{len(model.columns)}">{fields}</DataDictionary>'
        f'<RegressionModel functionName="regression"{link}><MiningSchema>{mining}</MiningSchema><RegressionTable intercept="{model.intercept!r}">{terms}</RegressionTable></RegressionModel></PMML>'
    )
    if path is not None:
        Path(path).write_text(text)
    return text


# --- ONNX: a linear form as one Gemm node, in the protocol buffers' wire format ---


def _varint(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor(name: str, dims: list[int], values: list[float]) -> bytes:
    raw = struct.pack(f"<{len(values)}f", *values)
    return b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name.encode()) + _field(9, raw)


def _info(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, b"N")) + _field(1, _field(1, width))
    return _field(1, name.encode()) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def _node(kind: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_field(1, i.encode()) for i in inputs) + _field(2, output.encode()) + _field(4, kind.encode())


def save_onnx_bytes(model: LinearModel) -> bytes:
    """A linear or logistic model: input X (rows, columns) of floats, output Y (rows, 1)."""
    d = len(model.columns)
    logistic = isinstance(model, LogisticModel)
    nodes = _field(1, _node("Gemm", ["X", "W", "B"], "Z" if logistic else "Y"))
    if logistic:
        nodes += _field(1, _node("Sigmoid", ["Z"], "Y"))
    weights = _field(5, _tensor("W", [d, 1], [float(b) for b in model.coefficients])) + _field(5, _tensor("B", [1], [float(model.intercept)]))
    graph = nodes + _field(2, b"model") + weights + _field(11, _info("X", d)) + _field(12, _info("Y", 1))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13))


def save_onnx(model: LinearModel, path: str) -> None:
    Path(path).write_bytes(save_onnx_bytes(model))
