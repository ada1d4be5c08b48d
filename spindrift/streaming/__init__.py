"""The batch expressions applied to streams (an extension)."""
