"""The array operators. A trailing underscore is the in-place form: a new array, of the destination's type."""
