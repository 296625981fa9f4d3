"""Sums over the tasks of a barrier stage, which hold on to their rows meanwhile.

The tasks form a binary tree of sockets: sums go up to the first task, what it says goes down. A message passes each
task once, and the driver sees only the addresses. A task that ends closes its sockets, so the others fail with it and
the stage is run again.
"""

from __future__ import annotations

import hmac
import json
import pickle
import secrets
import socket
from typing import Any

import numpy as np
from pyspark import BarrierTaskContext


def _send(to: socket.socket, data: bytes) -> None:
    to.sendall(len(data).to_bytes(8, "big") + data)


def _exactly(of: socket.socket, n: int) -> bytes:
    out = bytearray(n)
    view = memoryview(out)
    while len(view):
        got = of.recv_into(view)
        if not got:
            raise ConnectionError("another task of the stage has ended")
        view = view[got:]
    return bytes(out)


def _receive(of: socket.socket) -> bytes:
    return _exactly(of, int.from_bytes(_exactly(of, 8), "big"))


class Peers:
    """The tasks of this stage. All of them must make the same calls in the same order."""

    def __init__(self) -> None:
        context = BarrierTaskContext.get()
        self.rank = context.partitionId()
        host = context.getTaskInfos()[self.rank].address.rsplit(":", 1)[0]
        server = socket.create_server((host, 0))
        word = secrets.token_hex(16)
        known = [json.loads(x) for x in context.allGather(json.dumps([host, server.getsockname()[1], word]))]
        self.parent, self.children = None, []
        if self.rank:
            to, port, secret = known[(self.rank - 1) // 2]
            self.parent = socket.create_connection((to, port))
            self.parent.sendall(f"{secret}{self.rank:08}".encode())
        awaited = [k for k in (2 * self.rank + 1, 2 * self.rank + 2) if k < len(known)]
        came: dict[int, socket.socket] = {}
        while len(came) < len(awaited):
            child, _ = server.accept()
            hello = _exactly(child, len(word) + 8)
            if hmac.compare_digest(hello[: len(word)], word.encode()):
                came[int(hello[len(word) :])] = child
            else:
                child.close()
        server.close()
        self.children = [came[k] for k in awaited]
        for s in (*self.children, *([self.parent] if self.parent else [])):
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __enter__(self) -> Peers:
        return self

    def __exit__(self, *_: object) -> None:
        for s in (*self.children, *([self.parent] if self.parent else [])):
            s.close()

    def sum(self, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray | None:
        """The sum over all tasks in the first one, nothing in the others."""
        for child in self.children:
            values = how(values, np.frombuffer(_receive(child), values.dtype).reshape(values.shape))
        if self.parent:
            _send(self.parent, np.ascontiguousarray(values).tobytes())
            return None
        return values

    def tell(self, what: Any) -> Any:
        """What the first task says, in all tasks."""
        data = _receive(self.parent) if self.parent else pickle.dumps(what)
        for child in self.children:
            _send(child, data)
        return pickle.loads(data) if self.parent else what

    def all(self, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        """The sum over all tasks, in all of them."""
        return self.tell(self.sum(values, how))
