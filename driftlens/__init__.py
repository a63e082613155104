"""driftlens: Spark-native analysis of silent data incidents.

Every public function takes DataFrames and returns DataFrames; Catalyst picks the
physical strategy. Start with :mod:`driftlens.plans.revenue`.
"""
