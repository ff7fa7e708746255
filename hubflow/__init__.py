"""hubflow: parcel-logistics analytics as PySpark DataFrame operators.

Layers:
  functions/  Column expressions (clock of day, window labels, codes, rates)
  operators/  DataFrame -> DataFrame steps (filters, windows, classification,
              hour profiles, curves, staffing, backlog)
  sources/    table reads, the full-refresh sink, and the mapping of the
              driver's test tables onto the job inputs
  plans/      end-to-end jobs (shift, curve and backlog reports) and the
              registered queries
"""

__version__ = "0.1.0"
