"""Particle analytics on Spark DataFrames.

Four relations carry everything:

``positions``  frame, pid, x, y, z [, any scalar field]
``bonds``      frame, low, high, d2            (low < high)
``traj``       tr, frame, pid
``tracks``     tr, frame, x, y, z              (= positions joined with traj)

Every operator takes and returns DataFrames.  ``keys`` names the columns that separate independent
systems (``("frame",)`` by default, ``("sample", "frame")`` for several experiments at once).
"""

__version__ = "0.1.0"
