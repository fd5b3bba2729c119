import pathlib
import sys

HERE = pathlib.Path(__file__).parent
sys.path[:0] = [str(HERE), str(HERE.parent.parent)]
