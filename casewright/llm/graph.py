"""The recurrent steps of the tagger as a graph of the inference library onnxruntime, written byte by byte: the library reads
protocol buffers, and the package that writes them is not needed for the few messages here. Without the library
the tagger's numpy steps give the same scores up to the error of their tanh."""

from __future__ import annotations

import numpy as np

try:
    import onnxruntime
except ImportError:
    onnxruntime = None

FLOAT, INT = 1, 6  # element types of the format
TYPES = {np.dtype(np.float32): FLOAT, np.dtype(np.int32): INT}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(k: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(k << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(k << 3 | 2) + _number(len(value)) + value


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in a.shape) + _field(2, TYPES[a.dtype]) + _field(8, name) + _field(9, a.tobytes())


def _attribute(name: str, value: int | bytes) -> bytes:
    return _field(1, name) + (_field(3, value) + _field(20, 2) if isinstance(value, int) else _field(6, value) + _field(20, 5))


def _node(kind: str, inputs: str, outputs: str, **attributes) -> bytes:
    names = b"".join(_field(1, x) for x in inputs.split()) + b"".join(_field(2, x) for x in outputs.split())
    return names + _field(4, kind) + b"".join(_field(5, _attribute(k, v)) for k, v in attributes.items())


def _value(name: str, kind: int, *shape: str | int) -> bytes:
    dims = b"".join(_field(1, _field(1, n) if isinstance(n, int) else _field(2, n)) for n in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def _graph(name: str, nodes: list[bytes], inputs: list[bytes], outputs: list[bytes], constants: dict[str, np.ndarray]) -> bytes:
    parts = [_field(1, n) for n in nodes] + [_field(2, name)] + [_field(5, _tensor(k, v)) for k, v in constants.items()]
    return b"".join(parts + [_field(11, v) for v in inputs] + [_field(12, v) for v in outputs])


def session(p: dict[str, np.ndarray]):
    """A session with inputs x0 and x1 (steps x batch, characters in the order each direction reads them) and start (batch x
    hidden zeros), and outputs y0 and y1 (steps x batch x tags); None without the library."""
    if onnxruntime is None:
        return None
    h, n = p["U0"].shape[0], p["W"].shape[1]
    constants, nodes = {}, []
    for d in "01":
        table, constants[f"w{d}"], step = p["E" + d] + p["b" + d], p["W"][:h] if d == "0" else p["W"][h:], []
        # A product for each gate: no array is split.
        for k, (gate, act) in enumerate((("i", "Sigmoid"), ("f", "Sigmoid"), ("o", "Sigmoid"), ("c", "Tanh"))):
            own = slice(k * h, k * h + h)
            constants |= {f"table_{gate}{d}": table[:, own], f"u_{gate}{d}": p["U" + d][:, own]}
            step += [_node("Gather", f"table_{gate}{d} x", f"e_{gate}"), _node("Gemm", f"state u_{gate}{d} e_{gate}", f"g_{gate}"), _node(act, f"g_{gate}", gate)]
        step += [
            _node("Mul", "f cell", "kept"),
            _node("Mul", "i c", "added"),
            _node("Add", "kept added", "cell_"),
            _node("Tanh", "cell_", "r"),
            _node("Mul", "o r", "state_"),
            _node("MatMul", f"state_ w{d}", "out"),
        ]
        both = lambda *names: [_value(k, FLOAT, "batch", h) for k in names]
        body = _graph("step", step, [*both("state", "cell"), _value("x", INT, "batch")], [*both("state_", "cell_"), _value("out", FLOAT, "batch", n)], {})
        nodes.append(_node("Scan", f"start start x{d}", f"s{d} c{d} y{d}", body=body, num_scan_inputs=1))
    inputs = [_value("x0", INT, "steps", "batch"), _value("x1", INT, "steps", "batch"), _value("start", FLOAT, "batch", h)]
    outputs = [_value(f"y{d}", FLOAT, "steps", "batch", n) for d in "01"]
    model = _field(1, 8) + _field(7, _graph("scores", nodes, inputs, outputs, constants)) + _field(8, _field(1, "") + _field(2, 17))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
