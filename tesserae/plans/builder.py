"""Graphs built by hand: nodes are added, connected and disconnected by name before they become a plan."""

from __future__ import annotations

from collections.abc import Mapping

from tesserae.plans import graph
from tesserae.plans.nodes import Plan


class Builder:
    """Nodes and connections; a port takes one connection, and a node feeds one port unless it is the screen or a distributor."""

    def __init__(self):
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []

    def add(self, node_id: str, kind: str, **settings) -> Handle:
        self.nodes[node_id] = {"id": node_id, "type": kind, **settings}
        return Handle(self, node_id)

    def connect(self, source: str, target: str, port: str = "in") -> bool:
        """False, and nothing changes, if either end is taken already or isn't there."""
        known = {*self.nodes, graph.SCREEN}
        several = source == graph.SCREEN or self.nodes.get(source, {}).get("type") == "distributor"
        taken = any((e["toNodeId"], e["toPortId"]) == (target, port) or (e["fromNodeId"] == source and not several) for e in self.edges)
        if taken or source not in known or target not in known:
            return False
        self.edges.append({"fromNodeId": source, "toNodeId": target, "toPortId": port})
        return True

    def disconnect(self, node_id: str) -> int:
        """Takes all connections of a node away; how many there were."""
        left = [e for e in self.edges if node_id not in (e["fromNodeId"], e["toNodeId"])]
        gone, self.edges = len(self.edges) - len(left), left
        return gone

    def plan(self, images: Mapping[int, tuple], **screen) -> Plan:
        return graph.from_dict(list(self.nodes.values()), self.edges, images, **screen)


class Handle:
    """A node of a builder: a >> b feeds b from a, a << b feeds a from b; both give the node that comes last."""

    def __init__(self, builder: Builder, node_id: str):
        self.builder, self.node_id = builder, node_id

    def connect_to(self, target: Handle | str, port: str = "in") -> bool:
        return self.builder.connect(self.node_id, getattr(target, "node_id", target), port)

    def connect_from(self, source: Handle | str, port: str = "in") -> bool:
        return self.builder.connect(getattr(source, "node_id", source), self.node_id, port)

    def disconnect_all(self) -> int:
        return self.builder.disconnect(self.node_id)

    def __rshift__(self, target: Handle | str) -> Handle:
        self.connect_to(target)
        return target if isinstance(target, Handle) else Handle(self.builder, target)

    def __lshift__(self, source: Handle | str) -> Handle:
        self.connect_from(source)
        return source if isinstance(source, Handle) else Handle(self.builder, source)
