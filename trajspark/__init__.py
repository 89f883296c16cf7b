"""Trajectory analytics on Spark DataFrames.

A trajectory ("episode") is an ordered list of steps.  Every operator in this
package takes and returns DataFrames: steps become features, features become
scores, scores become alarms, and alarms become tables.
"""

__version__ = "0.1.0"
