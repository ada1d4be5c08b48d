"""Column expressions: functions from Column to Column, without Python at run time."""
