"""Plain single-process run of the greedy vertex program, for tests only.

One function per phase; messages are ``(sender id, value)`` pairs. After the first
superstep only vertices that got messages in the step before send.
"""

from __future__ import annotations

from dataclasses import dataclass, field

WHITE, GRAY, BLACK = -3, -4, -5


@dataclass
class Vertex:
    id: int
    color: int = WHITE
    value: int = 0
    step: int = 1
    out: tuple[int, int] = field(default=(0, WHITE))

    @property
    def halted(self) -> bool:
        return self.step < 0


def recolour(v: Vertex, got):
    if v.color != BLACK and any(value == BLACK for _, value in got):
        v.color = GRAY
    v.out = (v.id, v.color)


def span(v: Vertex, got):
    v.value = sum(value == WHITE for _, value in got)
    covered = v.color == BLACK or (v.color == GRAY and v.value == 0)
    v.out = (v.id, -1 if covered else v.value)


def best_of_neighbours(v: Vertex, got):
    acting = [(value, -sender) for sender, value in got if value != -1]
    count, sender = max([(v.value, -v.id), *acting])
    v.out = (-sender, count)
    if not acting:
        v.value, v.step = v.step + 1, -2  # halts; the step goes on to -1


def select(v: Vertex, got):
    if v.color != BLACK and all((value, -sender) <= (v.value, -v.id) for sender, value in got):
        v.color = BLACK
    v.out = (v.id, v.color)


PHASES = (recolour, span, best_of_neighbours, select)


def simulate_greedy(edges, max_iter=2000):
    """({id: (color, value)}, iterations, stopped by the cap)."""
    vertices = {i: Vertex(i, out=(i, WHITE)) for edge in edges for i in edge}

    def messages(senders):
        box = {}
        for s, d in edges:
            if s in senders and not vertices[s].halted:
                box.setdefault(d, []).append(vertices[s].out)
        return box

    box, rounds = messages(vertices.keys()), 0
    while box and rounds < max_iter:
        for i, got in box.items():
            if not vertices[i].halted:
                PHASES[vertices[i].step % 4](vertices[i], got)
                vertices[i].step += 1
        box = messages(box.keys())
        rounds += 1
    return {i: (v.color, v.value) for i, v in vertices.items()}, rounds, bool(box)


def both_ways(pairs):
    return [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
