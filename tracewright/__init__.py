"""Tracewright: profiling, trace mining and workload simulation as Spark jobs."""
