"""All registered queries of the library: name -> function of (spark, sf_dir), and name -> oracle SQL."""

from __future__ import annotations

from . import dossiers, evolution, graph, measures, navigation, records, replay, rules, scopes, snapshots, store, streams

FLAGSHIP = "coupling_type"
QUERIES: dict = {**graph.QUERIES, **evolution.QUERIES, **streams.QUERIES, **store.QUERIES, **records.QUERIES, **navigation.QUERIES, **measures.QUERIES, **snapshots.QUERIES, **rules.QUERIES, **dossiers.QUERIES, **scopes.QUERIES, **replay.QUERIES}
ORACLES: dict = {**graph.ORACLES, **evolution.ORACLES, **streams.ORACLES, **store.ORACLES, **records.ORACLES, **navigation.ORACLES, **measures.ORACLES, **snapshots.ORACLES, **rules.ORACLES, **dossiers.ORACLES, **scopes.ORACLES, **replay.ORACLES}
