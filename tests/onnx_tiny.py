"""Write a tiny ONNX model without the onnx package (protobuf wire format by hand).

Graph: logits[N,8] = Cast<float>(input_ids[N,128]) @ W[128,8]; attention_mask is a declared,
unused input. Test helper only.
"""
import numpy as np


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        out.append(b | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def _int(field: int, v: int) -> bytes:
    return _key(field, 0) + _varint(v)


def _bytes(field: int, b: bytes) -> bytes:
    return _key(field, 2) + _varint(len(b)) + b


def _str(field: int, s: str) -> bytes:
    return _bytes(field, s.encode())


FLOAT, INT64 = 1, 7


def _value_info(name: str, elem: int, dims) -> bytes:
    shape = b"".join(_bytes(1, _str(2, d) if isinstance(d, str) else _int(1, d)) for d in dims)
    tensor_type = _int(1, elem) + _bytes(2, shape)
    return _str(1, name) + _bytes(2, _bytes(1, tensor_type))


def write_linear_model(path: str, weights: np.ndarray, input_name: str = "input_ids") -> None:
    w = np.asarray(weights, dtype=np.float32)
    cast = (_str(1, input_name) + _str(2, "x") + _str(3, "cast") + _str(4, "Cast")
            + _bytes(5, _str(1, "to") + _int(20, 2) + _int(3, FLOAT)))
    matmul = _str(1, "x") + _str(1, "W") + _str(2, "logits") + _str(3, "mm") + _str(4, "MatMul")
    init = (b"".join(_int(1, d) for d in w.shape) + _int(2, FLOAT) + _str(8, "W")
            + _bytes(9, w.tobytes()))
    graph = (_bytes(1, cast) + _bytes(1, matmul) + _str(2, "tiny") + _bytes(5, init)
             + _bytes(11, _value_info(input_name, INT64, ["N", w.shape[0]]))
             + _bytes(11, _value_info("attention_mask", INT64, ["N", w.shape[0]]))
             + _bytes(12, _value_info("logits", FLOAT, ["N", w.shape[1]])))
    model = _int(1, 8) + _str(2, "reqsight-test") + _bytes(7, graph) + _bytes(8, _str(1, "") + _int(2, 13))
    with open(path, "wb") as f:
        f.write(model)

