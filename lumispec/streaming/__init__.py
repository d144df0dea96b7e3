"""What lumispec computes is a batch over a set of spectra; nothing in its scope keeps state over a stream."""
